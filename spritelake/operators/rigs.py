"""Rigs: slots, mirror pairs, part contracts, skeletons from part sizes, clip packs and rig documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHETYPES = ("biped-side", "quadruped-side", "winged-quadruped-side")

# Slot, joint, z, and the pivot as shares of width and height.
BIPED_SLOTS = [
    ("cape", "cape", -1, 0.5, 0.06),
    ("thigh_b", "hip_b", 0, 0.5, 0.06),
    ("shin_b", "kn_b", 0, 0.5, 0.06),
    ("leg_b", "hip_b", 0, 0.5, 0.06),
    ("legs", "hip_c", 0, 0.5, 0.06),
    ("uarm_b", "sh_b", 1, 0.5, 0.06),
    ("farm_b", "el_b", 1, 0.5, 0.06),
    ("arm_b", "sh_b", 1, 0.5, 0.06),
    ("hair_b", "hair_b", 1, 0.5, 0.08),
    ("torso", "spine", 2, 0.5, 0.62),
    ("head", "neck", 3, 0.5, 0.82),
    ("thigh_f", "hip_f", 4, 0.5, 0.06),
    ("shin_f", "kn_f", 4, 0.5, 0.06),
    ("leg_f", "hip_f", 4, 0.5, 0.06),
    ("uarm_f", "sh_f", 5, 0.5, 0.06),
    ("farm_f", "el_f", 5, 0.5, 0.06),
    ("arm_f", "sh_f", 5, 0.5, 0.06),
    ("weapon", "grip", 6, 0.25, 0.5),
]
QUADRUPED_SLOTS = [
    ("tail", "tail", -1, 0.88, 0.46),
    ("hindleg_b", "hindleg_b", 0, 0.5, 0.07),
    ("foreleg_b", "foreleg_b", 0, 0.5, 0.07),
    ("wing_b", "wing_b", 1, 0.16, 0.72),
    ("body", "body", 2, 0.5, 0.5),
    ("wing_f", "wing_f", 3, 0.16, 0.72),
    ("hindleg_f", "hindleg_f", 4, 0.5, 0.07),
    ("foreleg_f", "foreleg_f", 4, 0.5, 0.07),
    ("head", "head", 5, 0.15, 0.58),
]
BIPED_MIRRORS = [("uarm_f", "uarm_b"), ("farm_f", "farm_b"), ("arm_f", "arm_b"), ("thigh_f", "thigh_b"), ("shin_f", "shin_b"), ("leg_f", "leg_b")]
QUADRUPED_MIRRORS = [("foreleg_f", "foreleg_b"), ("hindleg_f", "hindleg_b"), ("wing_f", "wing_b")]
BIPED_ALIASES = [("body", "torso"), ("front_arm", "arm_f"), ("back_arm", "arm_b"), ("front_leg", "leg_f"), ("back_leg", "leg_b")]
QUADRUPED_ALIASES = [
    ("torso", "body"), ("front_leg_f", "foreleg_f"), ("front_leg_b", "foreleg_b"), ("back_leg_f", "hindleg_f"), ("back_leg_b", "hindleg_b"), ("rearleg_f", "hindleg_f"), ("rearleg_b", "hindleg_b"), ("wing", "wing_f"),
    ("leg_front_f", "foreleg_f"), ("leg_front_b", "foreleg_b"), ("leg_back_f", "hindleg_f"), ("leg_back_b", "hindleg_b"),
]


def tables(archetype: str) -> tuple[list, list, list]:
    """Slots, mirror pairs and aliases of an archetype."""
    if archetype not in ARCHETYPES:
        raise ValueError(f"unknown archetype {archetype!r}")
    return (BIPED_SLOTS, BIPED_MIRRORS, BIPED_ALIASES) if archetype == "biped-side" else (QUADRUPED_SLOTS, QUADRUPED_MIRRORS, QUADRUPED_ALIASES)


def slots(spark: SparkSession, archetype: str = "biped-side") -> DataFrame:
    return spark.createDataFrame(tables(archetype)[0], "slot string, joint string, z int, pivot_x double, pivot_y double")


def slotted(parts: DataFrame, name: str, archetype: str = "biped-side") -> DataFrame:
    """Parts with slot, joint, z and pivot by name or alias; names count without case, - as _."""
    spark = parts.sparkSession
    aliases = F.broadcast(spark.createDataFrame(tables(archetype)[2], "alias string, canonical string"))  # a dozen rows
    token = F.replace(F.lower(F.trim(F.col(name))), F.lit("-"), F.lit("_"))
    named = parts.withColumn("_token", token).join(aliases, F.col("_token") == F.col("alias"), "left")
    return named.withColumn("slot", F.coalesce("canonical", "_token")).drop("alias", "canonical", "_token").join(F.broadcast(slots(spark, archetype)), "slot", "left")


def slot_faults(named: DataFrame, owner: str) -> DataFrame:
    """owner, slot, rule of slotted parts: unknown names, and slots that an owner fills more than once."""
    unknown = named.where("joint IS NULL").select(owner, "slot", F.lit("unknown").alias("rule"))
    often = named.where("joint IS NOT NULL").groupBy(owner, "slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return unknown.unionByName(often.select(owner, "slot", F.lit("repeated").alias("rule")))


def with_mirrors(parts: DataFrame, archetype: str = "biped-side") -> DataFrame:
    """owner, slot, from_slot, derived: adds the missing member of each mirror pair, to be drawn as a
    darkened copy of the other."""
    pairs = tables(archetype)[1]
    both = F.broadcast(parts.sparkSession.createDataFrame(pairs + [(b, a) for a, b in pairs], "slot string, other string"))
    own = parts.select("owner", "slot").distinct()
    made = own.join(both, "slot").select("owner", F.col("other").alias("slot"), F.col("slot").alias("from_slot")).join(own, ["owner", "slot"], "left_anti")
    return own.select("owner", "slot", F.lit(None).cast("string").alias("from_slot"), F.lit(False).alias("derived")).unionByName(made.withColumn("derived", F.lit(True)))


# What a production rig needs.  Each group lists its alternatives, of which one has to be whole.
NEEDED = {
    "biped-side": {"head": [["head"]], "torso": [["torso"]], "arms": [["arm_f", "arm_b"], ["uarm_f", "farm_f", "uarm_b", "farm_b"]], "legs": [["leg_f", "leg_b"], ["thigh_f", "shin_f", "thigh_b", "shin_b"]]},
    "quadruped-side": {"head": [["head"]], "body": [["body"]], "forelegs": [["foreleg_f", "foreleg_b"]], "hindlegs": [["hindleg_f", "hindleg_b"]]},
}
NEEDED["winged-quadruped-side"] = NEEDED["quadruped-side"] | {"wings": [["wing_f", "wing_b"]]}
EXCLUSIVE = {"biped-side": {"mixed arms": (["arm_f", "arm_b"], ["uarm_f", "uarm_b", "farm_f", "farm_b"]), "mixed legs": (["leg_f", "leg_b"], ["thigh_f", "thigh_b", "shin_f", "shin_b"])}}
UNSUPPORTED = {"biped-side": ["legs"], "quadruped-side": ["wing_f", "wing_b"], "winged-quadruped-side": []}


def part_faults(parts: DataFrame, archetype: str = "biped-side") -> DataFrame:
    """owner, fault: groups of slots that lack or exclude each other, unsupported slots and wrong joints.

    ``parts``: owner, slot, joint.  An owner's slots are fewer than the slots there are, so its
    set is small; names outside the contract are told one by one.
    """
    supported = {s: j for s, j, *_ in tables(archetype)[0] if s not in UNSUPPORTED[archetype]}
    known = F.array(*map(F.lit, supported))
    have = parts.groupBy("owner").agg(F.collect_set(F.when(F.array_contains(known, F.col("slot")), F.col("slot"))).alias("have"))
    literal = lambda names: F.array(*map(F.lit, names))
    whole = lambda names: F.size(F.array_except(literal(names), "have")) == 0
    lacking = []
    for group, ways in NEEDED[archetype].items():
        ready = F.lit(False)
        for names in ways:
            ready = ready | whole(names)
        lacking.append(F.when(~ready, F.lit(f"missing {group}")))
    mixed = [F.when(F.arrays_overlap("have", literal(a)) & F.arrays_overlap("have", literal(b)), F.lit(name)) for name, (a, b) in EXCLUSIVE.get(archetype, {}).items()]
    sets = have.select("owner", F.explode(F.array_compact(F.array(*lacking, *mixed))).alias("fault"))
    joint_of = F.create_map(*(F.lit(x) for pair in supported.items() for x in pair))
    wrong = F.when(~F.array_contains(known, F.col("slot")), F.concat(F.lit("unsupported "), "slot")).when(~F.col("joint").eqNullSafe(joint_of[F.col("slot")]), F.concat(F.lit("joint of "), "slot"))
    single = parts.select("owner", wrong.alias("fault")).where("fault IS NOT NULL").distinct()
    return sets.unionByName(single)


def _sizes(parts: DataFrame) -> DataFrame:
    """One row an owner: the sizes of its slots as a map (as many entries as there are slots)."""
    return parts.groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))))).alias("part"))


def skeletons(parts: DataFrame, height: int = 512, archetype: str = "biped-side") -> DataFrame:
    """owner, canvas_w, canvas_h, scale, joint, parent, ox, oy: a skeleton by fixed ratios of part sizes.

    ``parts``: owner, slot, w, h.  Owners without the parts that give the proportions (head and
    torso, or head and body) have none.  Parts are scaled to whole pixels, at least one.
    """
    base = _sizes(parts)
    biped = archetype == "biped-side"
    trunk = "torso" if biped else "body"
    has = lambda s: F.map_contains_key("part", s)
    size = lambda s, c: F.element_at("part", F.lit(s))[c]
    first = lambda c, *names: F.coalesce(*(size(n, c) for n in names), F.lit(0.0))
    even = lambda x: F.bround(x / 2).cast("int") * 2
    base = base.where(has("head") & has(trunk))
    # The ratios of both builds.
    if biped:
        any_of = lambda *names: F.greatest(*(has(n).cast("int") for n in names)) == 1
        split, single = any_of("thigh_f", "thigh_b", "shin_f", "shin_b"), any_of("leg_f", "leg_b")
        legs = lambda a, b: F.when(split, (first("h", "thigh_f", "thigh_b") + first("h", "shin_f", "shin_b")) * a).when(single, first("h", "leg_f", "leg_b") * b).otherwise(first("h", "legs") * b)
        width = even(F.lit(height * 0.92))
        scale = F.lit(height * 0.66) / (size("head", "h") + size("torso", "h") + legs(1.0, 1.0))
    else:
        four = ("foreleg_f", "foreleg_b", "hindleg_f", "hindleg_b")
        longest = lambda: F.greatest(*(first("h", n) for n in four))
        width = even(F.lit(height * 1.28))
        scale = F.least(width * 0.72 / F.greatest(F.lit(1.0), size("body", "w") + size("head", "w") * 0.72 + first("w", "tail") * 0.58), F.lit(height * 0.60) / F.greatest(F.lit(1.0), size("body", "h") * 0.75 + longest()))
    scaled = base.withColumn("canvas_w", width).withColumn("scale", scale)
    fit = lambda v: F.greatest(F.lit(1.0), F.bround(v * F.col("scale")))
    scaled = scaled.withColumn("part", F.transform_values("part", lambda _, v: F.struct(fit(v["w"]).alias("w"), fit(v["h"]).alias("h"))))
    tw, th = size(trunk, "w"), size(trunk, "h")
    zero = F.lit(0.0)
    if biped:
        grip = F.when(has("farm_f"), "el_f").when(has("arm_f"), "sh_f").otherwise("spine")
        arm = F.when(has("farm_f"), first("h", "farm_f") * 0.90).otherwise(first("h", "arm_f") * 0.75)
        joints = [
            ("root", F.lit(None).cast("string"), F.col("canvas_w") / 2, F.lit(height * 0.82) - legs(0.88, 0.92) * 0.92), ("spine", F.lit("root"), zero, zero), ("cape", F.lit("spine"), zero, th * -0.48), ("neck", F.lit("spine"), zero, th * -0.55),
            ("hair_b", F.lit("neck"), zero, first("h", "head") * -0.60), ("sh_f", F.lit("spine"), tw * 0.06, th * -0.50), ("el_f", F.lit("sh_f"), zero, first("h", "uarm_f") * 0.88), ("sh_b", F.lit("spine"), tw * -0.06, th * -0.50),
            ("el_b", F.lit("sh_b"), zero, first("h", "uarm_b") * 0.88), ("hip_f", F.lit("root"), tw * 0.10, zero), ("kn_f", F.lit("hip_f"), zero, first("h", "thigh_f") * 0.88), ("hip_b", F.lit("root"), tw * -0.10, zero),
            ("kn_b", F.lit("hip_b"), zero, first("h", "thigh_b") * 0.88), ("hip_c", F.lit("root"), zero, zero), ("grip", grip, zero, arm),
        ]
        above = {"spine": "root", "cape": "spine", "neck": "spine", "hair_b": "neck", "sh_f": "spine", "el_f": "sh_f", "sh_b": "spine", "el_b": "sh_b", "hip_f": "root", "kn_f": "hip_f", "hip_b": "root", "kn_b": "hip_b", "hip_c": "root"}

        def used(joint: str) -> Column:
            """A part hangs on the joint or on one below it."""
            below = {joint}
            while more := {j for j, p in above.items() if p in below} - below:
                below |= more
            out = F.lit(joint in ("root", "spine"))
            for slot, at, *_ in BIPED_SLOTS:
                if at in below:
                    out = out | has(slot)
            return out | (has("weapon") & ((F.lit(joint) == "grip") | grip.isin(*below)))
    else:
        leg = longest()
        joints = [
            ("root", F.lit(None).cast("string"), F.col("canvas_w") * 0.50, F.lit(height * 0.82) - leg * 0.9 - th * 0.24), ("body", F.lit("root"), zero, zero), ("neck", F.lit("body"), tw * 0.42, th * -0.18), ("head", F.lit("neck"), zero, zero),
            ("tail", F.lit("body"), tw * -0.42, th * -0.10), ("foreleg_f", F.lit("body"), tw * 0.30, th * 0.24), ("foreleg_b", F.lit("body"), tw * 0.27, th * 0.22), ("hindleg_f", F.lit("body"), tw * -0.30, th * 0.24),
            ("hindleg_b", F.lit("body"), tw * -0.27, th * 0.22), ("wing_f", F.lit("body"), tw * -0.08, th * -0.22), ("wing_b", F.lit("body"), tw * -0.12, th * -0.18),
        ]
        used = lambda joint: F.lit(joint in ("root", "body", "neck", "head")) | has(joint)
    rows = F.array_compact(F.array(*(F.when(used(j), F.struct(F.lit(j).alias("joint"), p.alias("parent"), F.bround(x, 3).alias("ox"), F.bround(y, 3).alias("oy"))) for j, p, x, y in joints)))
    return scaled.select("owner", "canvas_w", F.lit(height).alias("canvas_h"), "scale", F.explode(rows).alias("j")).select("owner", "canvas_w", "canvas_h", "scale", "j.*")


PACK = "map<string, struct<fps:double,loop:boolean,grounded:boolean,tracks:map<string, map<string, array<array<double>>>>>>"


def clip_rows(packs: DataFrame, name: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(clips, keys) of clip packs given as JSON: a pack's name, its clips with their tracks of [time, value] pairs.

    clips: pack, clip, fps, loop, grounded; keys: pack, clip, joint, channel, k, t, value.
    """
    clips = packs.select(F.col(name).alias("pack"), F.explode(F.from_json(text, PACK)).alias("clip", "c")).select("pack", "clip", "c.*")
    joints = clips.select("pack", "clip", F.explode("tracks").alias("joint", "channels")).select("pack", "clip", "joint", F.explode("channels").alias("channel", "keys"))
    keys = joints.select("pack", "clip", "joint", "channel", F.posexplode("keys").alias("k", "pair")).select("pack", "clip", "joint", "channel", "k", F.col("pair")[0].alias("t"), F.col("pair")[1].alias("value"))
    flag = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    return clips.select("pack", "clip", "fps", flag("loop", True), flag("grounded", False)), keys


def with_speed(clips: DataFrame, contracts: DataFrame) -> DataFrame:
    """clip, fps, loop, fault: the profile's speed for each clip; clips without a contract or of another loop flag have a fault."""
    asked = contracts.select("clip", F.col("fps").alias("_fps"), F.coalesce("loop", F.lit(False)).alias("_loop"), F.lit(True).alias("_known"))
    fault = F.when(F.col("_known").isNull(), "no contract").when(F.coalesce("loop", F.lit(True)) != F.col("_loop"), "loop")
    return clips.join(asked, "clip", "left").select(*(c for c in clips.columns if c != "fps"), F.coalesce("_fps", "fps").cast("double").alias("fps"), fault.alias("fault"))


RIG = "struct<id:string,direction:string,archetype:string,canvas:array<int>,parts:map<string, struct<image:string,pivot:array<double>,joint:string,z:int>>,skeleton:map<string, struct<parent:string,offset:array<double>>>>"


def rig_parts(rigs: DataFrame, text: str, images: DataFrame) -> DataFrame:
    """Parts of rig documents with their decoded images: id, part, image, pivot, joint, z and the columns of
    ``images`` (path and others); fault tells of unsafe paths, missing images and unknown joints."""
    from ..functions.columns import safe_path

    docs = rigs.select(F.from_json(text, RIG).alias("r")).select("r.id", "r.skeleton", F.explode("r.parts").alias("part", "p"))
    flat = docs.select("id", "part", "p.*", F.map_contains_key("skeleton", F.col("p.joint")).alias("_joint"))
    joined = flat.join(images.withColumnRenamed("path", "image").withColumn("_found", F.lit(True)), "image", "left")
    fault = F.when(~safe_path(F.col("image")), "path").when(F.col("_found").isNull(), "image").when(~F.coalesce("_joint", F.lit(False)), "joint")
    return joined.withColumn("fault", fault).drop("_joint", "_found")


def rig_documents(rigs: DataFrame, parts: DataFrame, joints: DataFrame) -> DataFrame:
    """id, text: rig JSON with parts and skeleton as objects, pixels left out.

    ``rigs``: id, direction, archetype, canvas; ``parts``: id, part, image, pivot, joint, z and
    anything else; ``joints``: id, joint, parent, offset.  A rig's parts and joints are a few dozen rows.
    """
    of = lambda rows, key, value, name: rows.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))
    own = of(parts, F.col("part"), F.struct("image", "pivot", "joint", "z"), "parts")
    tree = of(joints, F.col("joint"), F.struct("parent", "offset"), "skeleton")
    whole = rigs.join(own, "id").join(tree, "id")
    return whole.select("id", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "id", "direction", "archetype", "canvas", "parts", "skeleton"), {"ignoreNullFields": "false"}).alias("text"))
