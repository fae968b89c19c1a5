"""Integrity of manifests: joins by path, id and digest, set comparisons, and gates as violation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"


def violations(rows: DataFrame, subject: Column, gate: str, when: Column, message: Column, severity: str = ERROR) -> DataFrame:
    """(subject, gate, severity, message) for the rows at fault."""
    return rows.where(F.coalesce(when, F.lit(False))).select(subject.cast("string").alias("subject"), F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), message.alias("message"))


def verdict(subjects: DataFrame, subject: str, *found: DataFrame) -> DataFrame:
    """One row a subject: errors and warnings in order of gates, and whether it has no error."""
    rows = reduce(DataFrame.unionByName, found)
    pick = lambda s: F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.concat_ws(": ", "gate", "message"))))
    per = rows.groupBy("subject").agg(pick(ERROR).alias("errors"), pick(WARNING).alias("warnings"))
    empty = F.array().cast("array<string>")
    out = subjects.select(F.col(subject).cast("string").alias("subject")).join(per, "subject", "left")
    return out.select("subject", F.coalesce("errors", empty).alias("errors"), F.coalesce("warnings", empty).alias("warnings")).withColumn("ok", F.size("errors") == 0)


def shared_across(rows: DataFrame, split: str, value: str) -> DataFrame:
    """Values in more than one split, by one aggregation."""
    per = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("rows"))
    return per.where("splits > 1")


def duplicated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def reconciled(declared: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """Every key that is missing, unexpected or of another digest: key, state."""
    d, a = declared.select(key, F.col(digest).alias("want")), actual.select(key, F.col(digest).alias("have"))
    both = d.withColumn("d", F.lit(True)).join(a.withColumn("a", F.lit(True)), key, "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("d").isNull(), "unexpected").when(~F.col("want").eqNullSafe(F.col("have")), "changed")
    return both.select(key, state.alias("state")).where("state IS NOT NULL")


def outer_report(manifest: DataFrame, boards: DataFrame, key: str, passed: str) -> DataFrame:
    """Manifest rows with their board's result; one without a board has failed with a reason."""
    joined = manifest.join(boards.withColumn("found", F.lit(True)), key, "left")
    return joined.select(key, F.coalesce(F.col(passed), F.lit(False)).alias("passed"), F.when(F.col("found").isNull(), "missing").when(~F.coalesce(F.col(passed), F.lit(False)), "failed").alias("reason"))


def batch_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("required"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ok"))


def set_difference(rows: DataFrame, want: Column, have: Column) -> DataFrame:
    """Adds missing and unknown: what each array lacks of the other."""
    return rows.withColumn("missing", F.array_sort(F.array_except(want, have))).withColumn("unknown", F.array_sort(F.array_except(have, want)))


def exactly_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the keys that occur once; an ambiguous key is an error when read."""
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("n", F.when(F.col("n") == 1, F.col("n")).otherwise(F.raise_error(F.lit("not exactly one match")).cast("long")))


def unmapped(components: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Components without a mapping and mappings without a component."""
    a = components.join(mapping, key, "left_anti").select(key, F.lit("unmapped").alias("state"))
    return a.unionByName(mapping.join(components, key, "left_anti").select(key, F.lit("unknown").alias("state")))


def fingerprint(files: DataFrame, group: list[str], path: str, digest: str) -> DataFrame:
    """SHA-256 over the sorted (path, digest) lines of each group."""
    line = F.concat_ws("|", path, digest)
    return files.groupBy(*group).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("fingerprint"))


def schedule(samples: Column, batch: int, target: int) -> list[Column]:
    """Updates an epoch, epochs, updates and what lies beyond the target."""
    per = F.ceil(samples / batch).cast("long")
    epochs = F.ceil(F.lit(target) / per).cast("long")
    return [per.alias("updates_per_epoch"), epochs.alias("epochs"), (per * epochs).alias("updates"), (per * epochs - target).alias("overshoot")]


def geometry_faults(w: Column, h: Column, columns: Column, rows: Column, frames: Column) -> Column:
    """Names of the rules that a board breaks: sides of 64 to 4096 in steps of 16, cells of whole pixels, room for the frames."""
    rules = [("width", w.between(64, 4096) & (w % 16 == 0)), ("height", h.between(64, 4096) & (h % 16 == 0)), ("columns", w % columns == 0), ("rows", h % rows == 0), ("capacity", frames <= columns * rows - 1)]
    return F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules)))


def clip_gate(rows: DataFrame, name: str, wanted: str, known: list[str]) -> DataFrame:
    """Rows of the wanted clip (equal or with its prefix); all rows if no name has the prefix of any known clip; else an error."""
    has = lambda c: (F.col(name) == c) | F.startswith(F.col(name), F.lit(f"{c}_"))
    other = reduce(Column.__or__, [has(c) for c in known if c != wanted], F.lit(False))
    counts = rows.agg(F.count_if(has(wanted)).alias("match"), F.count_if(other).alias("conflict"))
    joined = rows.crossJoin(F.broadcast(counts))  # one row
    keep = F.when(F.col("match") > 0, has(wanted)).when(F.col("conflict") == 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"no frames of {wanted}")).cast("boolean"))
    return joined.where(keep).drop("match", "conflict")
