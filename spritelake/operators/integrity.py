"""Integrity of datasets, locks and plans as violation rows; every rule is an aggregate or an equi-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECOMMENDED = 50  # fixed value: fewer training samples are a warning


def _rows(df: DataFrame, gate: str, subject: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))


def split_counts(samples: DataFrame, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """split, samples: 0 for a split that has none."""
    have = samples.groupBy("split").agg(F.count(F.lit(1)).alias("samples"))
    asked = samples.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return asked.join(have, "split", "left").fillna(0)


def dataset_faults(samples: DataFrame, entries: DataFrame, recommended: int = RECOMMENDED) -> DataFrame:
    """gate, severity, subject of a paired dataset.

    ``samples``: id, split, character, input_hash, target_hash; ``entries``: split, index, sample.
    Ids are unique; within a split inputs and targets are independent; no target and no picture of
    any kind is in both splits, nor a character; entries count from 1 without gaps and name just
    the samples of their split; a small training split is a warning.
    """
    twice = samples.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    both = samples.select("split", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("hash")) for c in ("input_hash", "target_hash")))).alias("h")).select("split", "h.*").where("hash IS NOT NULL")
    per = both.groupBy("hash").agg(*(F.count_if((F.col("split") == s) & (F.col("kind") == k)).alias(f"{s}_{k}") for s in ("train", "validation") for k in ("input_hash", "target_hash")))
    anywhere = lambda s: F.col(f"{s}_input_hash") + F.col(f"{s}_target_hash")
    character = samples.groupBy("character").agg(F.count_distinct("split").alias("n")).where("n > 1 AND character IS NOT NULL")
    order = entries.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("index").alias("different"), F.min("index").alias("least"), F.max("index").alias("most")).where("least <> 1 OR most <> n OR different <> n")
    named = entries.select("split", F.col("sample").alias("id")).distinct().withColumn("e", F.lit(True)).join(samples.select("split", "id").distinct().withColumn("s", F.lit(True)), ["split", "id"], "full_outer")
    few = split_counts(samples).where((F.col("split") == "train") & (F.col("samples") < recommended))
    found = [
        _rows(twice, "duplicate_id", F.col("id")),
        *(_rows(per.where(F.col(f"{s}_{k}") > 1), f"{s}_{k[:-5]}_repeats", F.col("hash")) for s in ("train", "validation") for k in ("input_hash", "target_hash")),
        _rows(per.where("train_target_hash > 0 AND validation_target_hash > 0"), "target_in_both", F.col("hash")),
        _rows(per.where((anywhere("train") > 0) & (anywhere("validation") > 0)), "picture_in_both", F.col("hash")),
        _rows(character, "character_in_both", F.col("character")),
        _rows(order, "entry_order", F.col("split")),
        _rows(named.where("s IS NULL"), "entry_without_sample", F.concat_ws("/", "split", "id")),
        _rows(named.where("e IS NULL"), "sample_without_entry", F.concat_ws("/", "split", "id")),
        _rows(few, "few_samples", F.col("samples"), "warning"),
    ]
    return reduce(DataFrame.unionByName, found)


def canonical_files(files: Column) -> Column:
    """Canonical JSON of an array of (path, bytes, sha256): sorted keys and no spaces."""
    one = lambda f: F.concat(F.lit('{"bytes":'), f["bytes"].cast("string"), F.lit(',"path":'), F.get(F.split(F.to_json(F.struct(f["path"].alias("p"))), r'^\{"p":|\}$'), 1), F.lit(',"sha256":"'), f["sha256"], F.lit('"}'))
    return F.concat(F.lit("["), F.array_join(F.transform(files, one), ","), F.lit("]"))


def lock_faults(locks: DataFrame) -> DataFrame:
    """Adds faults: names of the rules that a lock row (file_count, total_bytes, fingerprint, files) breaks.

    ``files`` is an array of (path, bytes, sha256) as the lock document has it.
    """
    files, from_1 = F.col("files"), F.sequence(F.lit(1), F.greatest(F.size("files") - 1, F.lit(1)))
    paths = files["path"]
    rising = F.forall(from_1, lambda i: F.coalesce(F.get(paths, i) >= F.get(paths, i - 1), F.lit(True)))
    total = F.aggregate(files, F.lit(0).cast("long"), lambda s, f: s + f["bytes"])
    from ..functions.columns import safe_path

    rules = {
        "file_count": F.size("files") == F.col("file_count"), "unique": F.size(F.array_distinct(paths)) == F.size("files"), "sorted": rising, "bytes": (total == F.col("total_bytes")) & F.forall(files, lambda f: f["bytes"] >= 1),
        "paths": F.forall(files, lambda f: safe_path(f["path"])), "digests": F.forall(files, lambda f: f["sha256"].rlike("^[0-9a-f]{64}$")), "fingerprint": F.sha2(canonical_files(files).cast("binary"), 256) == F.col("fingerprint"),
    }
    return locks.withColumn("faults", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))))


def workflow_faults(workflows: DataFrame, text: str, most: int = 8) -> DataFrame:
    """Adds invalid: the first nodes (by name) of a workflow document that lack a class_type text or an
    inputs object; null where the document is no object with nodes."""
    nodes = F.from_json(text, "map<string,string>")
    kind = lambda v, key: F.schema_of_variant(F.try_variant_get(F.try_parse_json(v), f"$.{key}", "variant"))
    good = lambda v: F.coalesce((kind(v, "class_type") == "STRING") & F.startswith(kind(v, "inputs"), F.lit("OBJECT")), F.lit(False))
    bad = F.map_keys(F.map_filter(nodes, lambda _, v: ~good(v)))
    return workflows.withColumn("invalid", F.when(F.size(nodes) > 0, F.slice(F.array_sort(bad), 1, most)))


def low_disk(paths: DataFrame, least: float) -> DataFrame:
    """device, labels, free: devices on which a checked path has too little room, told once each.

    ``paths``: label, device (null: the anchor or the label stands for it), anchor, checked, free.
    A host's paths are a handful of rows.
    """
    low = paths.where(F.col("checked") & (F.col("free") < least))
    return low.groupBy(F.coalesce("device", "anchor", "label").alias("device")).agg(F.array_sort(F.collect_list("label")).alias("labels"), F.min("free").alias("free"))


def conflicts(rows: DataFrame, group: str, name: str, shown: int = 5) -> DataFrame:
    """group, text: the first conflicting names, and how many there are if more.  Bounded: a task keeps
    ``shown`` names a group."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(name)
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= shown).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("text"))
    total = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    more = F.when(F.col("total") > shown, F.concat(F.lit(", ... ("), F.col("total").cast("string"), F.lit(" total)"))).otherwise("")
    return first.join(total, group).select(group, F.concat("text", more).alias("text"))


def changed(approved: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key, field, approved, current of every value that differs when a plan is computed again."""
    fields = [c for c in approved.columns if c != key]
    long = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in fields))).alias("x")).select(key, "x.*")
    both = long(approved, "approved").join(long(current, "current"), [key, "field"], "full_outer")
    return both.where(~F.col("approved").eqNullSafe(F.col("current")))


def one_of(**given: object) -> str:
    """The name of the only input that is given; none or several are an error."""
    names = [k for k, v in given.items() if v is not None]
    if len(names) != 1:
        raise ValueError(f"exactly one of {', '.join(given)} is needed; given: {', '.join(names) or 'none'}")
    return names[0]
