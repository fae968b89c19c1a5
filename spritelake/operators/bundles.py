"""Exported splits and bundles against what they were made from, as violation rows.

Manifest entries, canonical samples and files meet in three equi-joins: entries with samples by id, and the
three files of each entry with the folder by path, from both sides.  Rules within an entry are conditions
of one grouped pass, so each table is read once.  Order and uniqueness of listed names come from a join of each
place with the one before it, not from a sort.  Every broken rule is a row (subject, rule).

entries: position, index, sample, prompt_index, input, target, prompt (paths within the bundle).
samples: sample, split, character, input_hash, target_hash.  files: path, w, h, hash, regular.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_TASK = 200_000  # rows that a task sorts for a join
FIELDS = {"input": "_in.png", "target": "_out.png", "prompt": "_in.txt"}  # fixed endings of the three names


def _faults(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule whose condition holds; conditions that are null don't."""
    broken = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return rows.select(subject.cast("string").alias("subject"), F.explode(broken).alias("rule"))


def split_faults(entries: DataFrame, samples: DataFrame, files: DataFrame, folder: str, split: str, prompts: int) -> DataFrame:
    """What is wrong with a split's entries and folder.

    index: not the entry's place from 1; duplicate: the sample of another entry too; unknown: no sample of this split;
    prompt_index; parent: not a flat child of the folder; reused: a path of two fields; names, basenames, number: of
    the three files; missing; sizes: input and target differ; input_pixels, target_pixels: not those of the sample;
    surplus: a file that no entry names, or none that is regular; image_sizes: more than one in the split.
    """
    base = lambda field: F.regexp_replace(F.regexp_replace(F.col(field), "^.*/", ""), FIELDS[field].replace(".", r"\.") + "$", "")
    # dealt by the number of rows, so what a task sorts doesn't grow with the input
    parts = max(1, -(-len(FIELDS) * entries.count() // PER_TASK))
    by_sample = entries.repartition(parts, "sample")
    same = by_sample.groupBy("sample").agg(F.count(F.lit(1)).alias("times"))
    known = samples.where(F.col("split") == split).repartition(parts, "sample").select("sample", "input_hash", "target_hash", F.lit(True).alias("known"))
    named = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("path")) for f in FIELDS))).alias("file")
    paths = entries.select("position", named).select("position", "file.*").repartition(parts, "path")
    files = files.repartition(parts, "path")
    uses = paths.groupBy("path").agg(F.count(F.lit(1)).alias("uses"))
    # one row a path on either side: entries and files that share a path don't multiply
    size = F.when(F.col("w").isNotNull(), F.struct("w", "h"))
    held = files.where("regular").groupBy("path").agg(*(F.max(c).alias(c) for c in ("w", "h", "hash")), F.bool_or(F.col("hash").isNull()).alias("lacking"), F.min(size).alias("least"), F.max(size).alias("most"))
    found = paths.join(uses, "path").join(held, "path", "left")
    of = lambda field, c: F.max(F.when(F.col("field") == field, F.col(c))).alias(f"{field}_{c}")
    facts = found.repartition(parts, "position").groupBy("position").agg(F.max("uses").alias("uses"), F.count_if(F.coalesce("lacking", F.lit(True))).alias("absent"), *(of(f, c) for f in ("input", "target") for c in ("w", "h", "hash")))
    rows = by_sample.join(same, "sample").join(known.withColumnsRenamed({"input_hash": "want_input", "target_hash": "want_target"}), "sample", "left").repartition(parts, "position").join(facts, "position")
    flat = [F.regexp_replace(F.col(f), "[^/]*$", "") == f"{folder}/" for f in FIELDS]
    endings = [F.endswith(F.col(f), F.lit(e)) for f, e in FIELDS.items()]
    rules = {
        "index": F.col("index") != F.col("position"), "duplicate": F.col("times") > 1, "unknown": F.col("known").isNull(), "prompt_index": ~F.col("prompt_index").between(0, prompts - 1),
        "parent": ~(flat[0] & flat[1] & flat[2]), "reused": F.col("uses") > 1, "names": ~(endings[0] & endings[1] & endings[2]), "basenames": (base("input") != base("target")) | (base("input") != base("prompt")),
        "number": ~base("input").rlike("^[0-9]+$") | (base("input").try_cast("long") != F.col("index")), "missing": F.col("absent") > 0, "sizes": (F.col("input_w") != F.col("target_w")) | (F.col("input_h") != F.col("target_h")),
        "input_pixels": F.col("input_hash") != F.col("want_input"), "target_pixels": F.col("target_hash") != F.col("want_target"),
    }
    own = _faults(rows, F.col("position"), rules)
    here = files.where(F.startswith("path", F.lit(f"{folder}/")))
    surplus = here.join(uses, "path", "left").where("uses IS NULL OR NOT regular").select(F.col("path").alias("subject"), F.lit("surplus").alias("rule"))
    sizes = found.where("field <> 'prompt'").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("NOT (least <=> most)").select(F.lit(folder).alias("subject"), F.lit("image_sizes").alias("rule"))
    return own.unionByName(surplus).unionByName(sizes)


def list_faults(names: DataFrame) -> DataFrame:
    """Faults of named lists (list, position, name) that must be sorted and unique: a name that doesn't come after the
    one before it (order) or equals it (repeated), an empty or padded name (blank), and places that are left out (gap)."""
    before = names.select("list", (F.col("position") + 1).alias("position"), F.col("name").alias("before"))
    rows = names.join(before, ["list", "position"], "left")
    subject = F.concat_ws("/", "list", F.col("position").cast("string"))
    rules = {"order": F.col("name") < F.col("before"), "repeated": F.col("name") == F.col("before"), "blank": F.col("name").isNull() | (F.trim("name") != F.col("name")) | (F.col("name") == ""), "gap": F.col("before").isNull() & (F.col("position") > 1)}
    return _faults(rows, subject, rules)


def disjoint_faults(names: DataFrame, a: str, b: str) -> DataFrame:
    """Names that are in both of two lists."""
    left, right = (names.where(F.col("list") == x).select("name").distinct() for x in (a, b))
    return left.join(right, "name").select(F.col("name").alias("subject"), F.lit("shared").alias("rule"))


def bundle_faults(declared: DataFrame, names: DataFrame, entries: DataFrame, files: DataFrame, characters: str = "train", holdout: str = "holdout", samples: str = "samples") -> DataFrame:
    """What is wrong with a bundle after a transfer, beside the lists' order and the entries' names.

    declared: one row (train_count, holdout_count, prompts, image_w, image_h).  entries: position, index, sample, character, prompt_index, and of
    each field its name and declared digest (input, input_sha256, ..).  files: name, w, h, sha256, regular.
    Counts that differ, sides that aren't multiples of 16 from 16, characters that aren't declared, digests that aren't
    one or aren't the file's, sizes other than the declared one, and files that nobody names.
    """
    lists = list_faults(names).unionByName(disjoint_faults(names, characters, holdout))
    counts = entries.agg(F.count(F.lit(1)).alias("entries")).join(names.agg(*(F.count_if(F.col("list") == x).alias(f"of_{x}") for x in (characters, holdout, samples))), how="cross").join(declared, how="cross")  # one row each
    side = lambda c: (F.col(c) < 16) | (F.col(c) % 16 != 0)
    whole = _faults(counts, F.lit("bundle"), {"train_count": F.col("entries") != F.col("train_count"), "holdout_count": F.col(f"of_{samples}") != F.col("holdout_count"), "no_characters": (F.col(f"of_{characters}") == 0) | (F.col(f"of_{holdout}") == 0), "image_size": side("image_w") | side("image_h")})
    listed = names.where(F.col("list") == characters).select(F.col("name").alias("character"), F.lit(True).alias("listed")).distinct()
    stated = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("name"), F.col(f"{f}_sha256").alias("digest")) for f in FIELDS))).alias("file")
    paths = entries.select("position", stated).select("position", "file.*")
    facts = paths.join(files.where("regular"), "name", "left")
    one = declared.select("image_w", "image_h", "prompts")
    image = F.col("field") != "prompt"
    per = facts.join(F.broadcast(one), how="cross").groupBy("position").agg(  # one row
        F.bool_or(F.col("sha256").isNull()).alias("absent"), F.bool_or(~F.col("digest").rlike("^[0-9a-f]{64}$") | F.col("digest").isNull()).alias("odd"), F.bool_or(F.col("digest") != F.col("sha256")).alias("differs"),
        F.bool_or(image & ((F.col("w") != F.col("image_w")) | (F.col("h") != F.col("image_h")))).alias("size"), F.first("prompts").alias("prompts"),
    )
    rows = entries.join(per, "position").join(listed, "character", "left")
    own = _faults(rows, F.col("position"), {"index": F.col("index") != F.col("position"), "character": F.col("listed").isNull(), "prompt_index": ~((F.col("prompt_index") >= 0) & (F.col("prompt_index") < F.col("prompts"))), "missing": F.col("absent"), "digest": F.col("odd"), "bytes": F.col("differs"), "size": F.col("size")})
    surplus = files.join(paths.select("name").distinct(), "name", "left_anti").select(F.col("name").alias("subject"), F.lit("surplus").alias("rule"))
    return lists.unionByName(whole).unionByName(own).unionByName(surplus)
