"""Keyframes, sample times, skeletons and ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordinals import ordinals


def sample_times(n: Column, loop: Column) -> Column:
    """i / n for a loop, else i / (n - 1); one sample lies at 0."""
    steps = F.when(loop, n).otherwise(n - 1)
    return F.when(n == 1, F.array(F.lit(0.0))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / steps))


def interpolated(keys: DataFrame, times: DataFrame, track: list[str], smooth: bool = False, default: float = 0.0) -> DataFrame:
    """Values of tracks at times: track, at, value for each row of ``times``.

    ``keys``: track, k, t, value in order of k; ``times``: track, at and, optionally, loop.  A
    loop's times count modulo 1, others are held within 0..1, and at 1 the last key counts.
    Between two keys the value runs from one to the other; at a key's time the first key of that
    time counts.  Before the first and after the last key the value stays, and a track without
    keys has the default.  Keys and times are sorted together by track, so each time meets the
    keys beside it and no others.
    """
    loop = F.coalesce("loop", F.lit(False)) if "loop" in times.columns else F.lit(False)
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("at")))
    asked = times.select(*track, "at", F.when(loop, F.pmod("at", F.lit(1.0))).when(held >= 1, F.lit(float("inf"))).otherwise(held).alias("t"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("value"))
    both = keys.select(*track, F.lit(None).cast("double").alias("at"), F.col("t").cast("double"), F.col("k").cast("long"), F.col("value").cast("double")).unionByName(asked)
    both = both.withColumn("key", F.when(F.col("k").isNotNull(), F.struct("t", "value")))
    over = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in track)} ORDER BY t, k NULLS FIRST)"
    beside = both.select("*", F.expr(f"lag(key) IGNORE NULLS {over}").alias("a"), F.expr(f"lead(key) IGNORE NULLS {over}").alias("b")).where("k IS NULL")
    share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    eased = 0.5 - 0.5 * F.cos(share * F.lit(3.141592653589793)) if smooth else share
    value = F.when(F.col("a").isNull(), F.col("b.value")).when(F.col("b").isNull(), F.col("a.value")).otherwise(F.col("a.value") + (F.col("b.value") - F.col("a.value")) * eased)
    return beside.select(*track, "at", F.coalesce(value, F.lit(default)).alias("value"))


def least_frames(keys: DataFrame, track: list[str], loop: Column) -> DataFrame:
    """Frames a track needs so that no motion is skipped: 1 if it loops or never moves, 3 if it moves
    between equal ends, else 2.  A clip needs the most of its tracks."""
    order = Window.partitionBy(*track).orderBy("k")
    first, value = F.first("value").over(order), F.col("value")
    away = F.abs(value - first) > F.lit(1e-9) * F.greatest(F.abs(value), F.abs(first))
    rows = keys.select(*track, "k", loop.alias("_loop"), away.alias("away"), F.lead("k").over(order).isNotNull().alias("inner"))
    per = rows.groupBy(*track).agg(F.bool_or("_loop").alias("_loop"), F.bool_or("away").alias("moves"), F.bool_or(F.col("away") & F.col("inner")).alias("between"), F.max_by("away", "k").alias("apart"))
    return per.select(*track, F.when(F.col("_loop") | ~F.col("moves"), 1).when(F.col("between") & ~F.col("apart"), 3).otherwise(2).alias("frames"))


def broken_ordinals(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Groups whose ordinals aren't 1, 2, 3 and so on: from counts and extremes, so nothing is sorted."""
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(ordinal).alias("different"), F.min(ordinal).alias("least"), F.max(ordinal).alias("most"))
    return per.where((F.col("least") != 1) | (F.col("most") != F.col("rows")) | (F.col("different") != F.col("rows"))).select(*keys, "rows", "least", "most")


def numbered(rows: DataFrame, split: str, order: str, prompts: int = 8, width: int = 4) -> DataFrame:
    """Adds ordinal (from 1 within the split), its file stem, padded to ``width`` digits or those of the split's last, and the
    cyclic prompt index.

    Splits are few and large: numbers come from range partitions, not from a window a split.
    """
    placed = ordinals(rows, [order], [split], total="total").withColumn("ordinal", (F.col("ordinal") + 1).cast("int"))
    digits = F.greatest(F.lit(width), F.length(F.col("total").cast("string")))
    return placed.withColumn("stem", F.lpad(F.col("ordinal").cast("string"), digits, F.lit("0"))).withColumn("prompt_index", F.pmod(F.col("ordinal") - 1, F.lit(prompts)).cast("int")).drop("total")


#: A biped's joints: (joint, parent, offset x, offset y, rest angle in degrees).
SKELETON = [("root", None, 0.0, 0.0, 0.0), ("torso", "root", 0.0, -12.0, 5.0), ("head", "torso", 0.0, -10.0, -3.0), ("arm_front", "torso", 5.0, -6.0, 30.0), ("arm_back", "torso", -5.0, -6.0, -30.0), ("leg_front", "root", 3.0, 1.0, 12.0), ("leg_back", "root", -3.0, 1.0, -12.0), ("hand_front", "arm_front", 0.0, 8.0, 10.0)]


def skeleton(spark: SparkSession, joints: list[tuple] = SKELETON) -> DataFrame:
    return spark.createDataFrame(joints, "joint string, parent string, ox double, oy double, angle double")


def world_transforms(joints: DataFrame) -> DataFrame:
    """joint, depth, angle, x, y of a tree from its root on: offsets are turned by the parent's angle,
    counter-clockwise where y points down.

    The recursion ends with the tree; a joint that a cycle or a missing parent keeps from the root
    is not in the result, so counting tells whether the graph is one tree.
    """
    spark = joints.sparkSession
    name = f"joints_{id(joints):x}"
    joints.createOrReplaceTempView(name)
    out = spark.sql(f"""
        WITH RECURSIVE world(joint, depth, angle, x, y) AS (
            SELECT joint, 0, angle, ox, oy FROM {name} WHERE parent IS NULL
            UNION ALL
            SELECT j.joint, w.depth + 1, w.angle + j.angle,
                   w.x + j.ox * cos(radians(w.angle)) + j.oy * sin(radians(w.angle)),
                   w.y - j.ox * sin(radians(w.angle)) + j.oy * cos(radians(w.angle))
            FROM world w JOIN {name} j ON j.parent = w.joint)
        SELECT * FROM world""")
    spark.catalog.dropTempView(name)  # the plan is resolved by now
    return out


def ancestors(joints: DataFrame, needed: list[str] | DataFrame) -> DataFrame:
    """The needed joints, a list or a table with a column ``joint``, and all joints above them."""
    spark = joints.sparkSession
    if not isinstance(needed, DataFrame):
        needed = spark.createDataFrame([(n,) for n in needed], "joint string")
    name = f"joints_{id(joints):x}_up"
    joints.createOrReplaceTempView(name)
    needed.createOrReplaceTempView(f"{name}_needed")
    out = spark.sql(f"""
        WITH RECURSIVE up(joint, parent) AS (
            SELECT joint, parent FROM {name} WHERE joint IN (SELECT joint FROM {name}_needed)
            UNION ALL SELECT j.joint, j.parent FROM up u JOIN {name} j ON j.joint = u.parent)
        SELECT DISTINCT joint FROM up""")
    spark.catalog.dropTempView(name)
    spark.catalog.dropTempView(f"{name}_needed")
    return out


def tree_faults(joints: DataFrame) -> DataFrame:
    """Why a joint table is not one tree: subject, gate."""
    roots = joints.where("parent IS NULL")
    many = roots.agg(F.count(F.lit(1)).alias("n")).where("n <> 1").select(F.lit("skeleton").alias("subject"), F.lit("one_root").alias("gate"))
    unknown = joints.where("parent IS NOT NULL").join(joints.select(F.col("joint").alias("parent")), "parent", "left_anti").select(F.col("joint").alias("subject"), F.lit("parent_exists").alias("gate"))
    lost = joints.join(world_transforms(joints).select("joint"), "joint", "left_anti").select(F.col("joint").alias("subject"), F.lit("reaches_root").alias("gate"))
    return many.unionByName(unknown).unionByName(lost)
