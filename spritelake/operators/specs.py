"""Dataset specs as tables: what samples they ask for, and what the folders have for them.

A spec's characters, directions and clips are rows; a generator join gives each sample its patterns,
templates become paths, and an equi-join on the folder finds the files that a pattern means.  What is missing,
too much, or leads out of its root is a row (subject, rule, told).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE = "^[a-z0-9][a-z0-9_-]*$"  # fixed: what an id looks like


def expanded(characters: DataFrame) -> DataFrame:
    """sample, character, direction, clip, root, path, expected: a row for each direction and clip of each character.

    characters: id, root, directions array<string>, clips array<struct<id, pattern, expected>>.  A pattern's {direction} and
    {clip} are filled in; null or empty lists ask for nothing.
    """
    rows = characters.select("id", "root", F.explode("directions").alias("direction"), "clips").select("id", "root", "direction", F.explode("clips").alias("c"))
    path = F.replace(F.replace("c.pattern", F.lit("{direction}"), F.col("direction")), F.lit("{clip}"), F.col("c.id"))
    return rows.select(F.concat_ws("__", "id", "direction", "c.id").alias("sample"), F.col("id").alias("character"), "direction", F.col("c.id").alias("clip"), "root", path.alias("path"), F.col("c.expected").alias("expected"))


def resolved(path: Column) -> Column:
    """A relative path without '.', '..' and empty parts; null if it leads out of where it starts."""
    step = lambda s, p: F.when(s.isNull() | ((p == "..") & (F.size(s) == 0)), F.lit(None)).when(p == "..", F.slice(s, F.lit(1), F.size(s) - 1)).when(p.isin("", "."), s).otherwise(F.concat(s, F.array(p)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~F.startswith(path, F.lit("/")), F.array_join(parts, "/"))


def _glob(pattern: Column) -> Column:
    """A file pattern's regular expression: * and ? don't cross folders, all else is itself."""
    quoted = F.regexp_replace(pattern, r"([\\.^$|()\[\]{}+])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))


def matched(asked: DataFrame, files: DataFrame) -> DataFrame:
    """sample, file, regular of the files (root, path, regular) that each asked path means."""
    folder, name = F.regexp_replace("inner", "/?[^/]*$", ""), F.regexp_replace("inner", "^.*/", "")
    wanted = asked.withColumn("inner", resolved(F.col("path"))).where("inner IS NOT NULL").select("sample", "root", folder.alias("folder"), _glob(name).alias("like"))
    have = files.select("root", F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.regexp_replace("path", "^.*/", "").alias("name"), F.col("path").alias("file"), "regular")
    return wanted.join(have, ["root", "folder"]).where(F.expr("name RLIKE like")).select("sample", "file", "regular")


def spec_faults(characters: DataFrame, files: DataFrame) -> DataFrame:
    """What is wrong: id (unsafe), collision (two samples of one id), escapes (a path out of its root), count (other than the
    expected frames), irregular (links and folders among the frames)."""
    asked = expanded(characters)
    times = asked.groupBy("sample").agg(F.count(F.lit(1)).alias("times"))
    found = matched(asked, files).groupBy("sample").agg(F.count_distinct("file").alias("found"), F.count_if(~F.col("regular")).alias("odd"))
    rows = asked.join(times, "sample").join(found, "sample", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    out = resolved(F.col("path")).isNull()
    rules = [
        ("id", ~(F.col("character").rlike(SAFE) & F.col("direction").rlike(SAFE)), F.col("path")), ("collision", F.col("times") > 1, F.col("times").cast("string")), ("escapes", out, F.col("path")),
        ("count", ~out & (F.col("found") != F.col("expected")), F.concat_ws(" ", F.lit("expected"), F.col("expected").cast("string"), F.lit("found"), F.col("found").cast("string"))), ("irregular", F.col("odd") > 0, F.col("odd").cast("string")),
    ]
    told = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(n).alias("rule"), t.alias("told"))) for n, broken, t in rules)))
    return rows.select(F.col("sample").alias("subject"), F.explode(told).alias("x")).select("subject", "x.*")


def restricted_tracks(tracks: DataFrame, joints: DataFrame, clips: list[str], scale: float) -> DataFrame:
    """Tracks (clip, joint, channel, t, value) of the asked clips, for the joints that a rig has, offsets scaled.

    Adds ``place``: the clip's in the list, in which names count once, at their first mention.  A clip that no track has is an error
    when the rows are read; joints are a table, so neither side is held whole.
    """
    names = list(dict.fromkeys(clips))
    wanted = tracks.sparkSession.createDataFrame(list(enumerate(names)), "place int, clip string")
    unknown = wanted.join(tracks.select("clip").distinct(), "clip", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == 0, True).otherwise(F.raise_error(F.lit("a clip is unknown")).cast("boolean")).alias("fine"))
    value = F.when(F.col("channel").isin("offset_x", "offset_y"), F.round(F.col("value") * scale, 6)).otherwise(F.col("value"))
    kept = tracks.join(F.broadcast(wanted), "clip").join(joints.select("joint").distinct(), "joint", "left_semi")  # names of a literal list
    return kept.join(F.broadcast(unknown), how="cross").where("fine").select("clip", "place", "joint", "channel", "t", value.alias("value"))  # one row
