"""Scalar expressions on pixels, names, paths, numbers and configuration text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- pixels


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer brightness in thousandths."""
    return 299 * r + 587 * g + 114 * b


def spread(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def neutral(r: Column, g: Column, b: Column, least: int, most_spread: int) -> Column:
    """Bright and nearly grey."""
    return (F.least(r, g, b) >= least) & (spread(r, g, b) <= most_spread)


def hardened(alpha: Column, threshold: int = 20) -> Column:
    """Alpha as 0 or 255; a pixel at the threshold is transparent."""
    return F.when(alpha > threshold, 255).otherwise(0)


def square_distance(r: Column, g: Column, b: Column, to: tuple[Column, Column, Column]) -> Column:
    """Squared RGB distance: whole numbers compare exactly where roots would not."""
    return (r - to[0]) * (r - to[0]) + (g - to[1]) * (g - to[1]) + (b - to[2]) * (b - to[2])


def darkened(channel: Column) -> Column:
    """85 in 100, cut to a whole number."""
    return F.floor(channel * 17 / 20).cast("int")


def padded_box(box: Column, by: int, w: Column, h: Column) -> Column:
    """A half-open box (x0, y0, x1, y1) grown by ``by`` within its canvas."""
    return F.struct(F.greatest(F.lit(0), box["x0"] - by).alias("x0"), F.greatest(F.lit(0), box["y0"] - by).alias("y0"), F.least(w, box["x1"] + by).alias("x1"), F.least(h, box["y1"] + by).alias("y1"))


def fit_scale(w: Column, h: Column, box_w: Column, box_h: Column, enlarge: bool = False) -> Column:
    """Scale that fits a size into a box and keeps its shape."""
    scale = F.least(box_w / w, box_h / h)
    return scale if enlarge else F.least(F.lit(1.0), scale)


def centred(outer: Column, inner: Column) -> Column:
    """Offset that centres a length; an inner length above the outer one is an error."""
    return F.when(inner <= outer, F.floor((outer - inner) / 2).cast("int")).otherwise(F.raise_error(F.lit("larger than its cell")).cast("int"))


# ---- names and order


def natural_key(name: Column) -> Column:
    """Array of (text, number) that orders ``frame2`` before ``frame10``; ASCII digits count as numbers."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike("^[0-9]"), F.lit("")).otherwise(p).alias("text"), F.when(p.rlike("^[0-9]"), p.cast("decimal(38,0)")).otherwise(F.lit(-1)).alias("number")))


def clip_rank(name: Column, order: tuple[str, ...] = ("idle", "walk", "attack", "hit", "death")) -> Column:
    """Known clips in their usual order, others after them."""
    at = F.array_position(F.array(*map(F.lit, order)), name)
    return F.when(at == 0, len(order) + 1).otherwise(at).cast("int")


def node_key(name: Column) -> Column:
    """Orders numeric names by value before all others."""
    digits = name.rlike("^[0-9]+$")
    return F.struct(F.when(digits, 0).otherwise(1).alias("kind"), F.when(digits, name.cast("decimal(38,0)")).alias("number"), name.alias("name"))


def identifier(name: Column) -> Column:
    return F.coalesce(name.rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False))


def plain_text(text: Column) -> Column:
    """Non-empty and free of NUL and line ends."""
    return F.coalesce((F.trim(text) != "") & ~text.rlike("[\\x00\\r\\n]"), F.lit(False))


# ---- paths


def safe_path(path: Column) -> Column:
    """Relative, with forward slashes, and never leaving its root."""
    return F.coalesce((path != "") & ~path.rlike(r"^([/~]|[A-Za-z]:)|\\|(^|/)\.\.(/|$)|\x00"), F.lit(False))


def normal_prefix(prefix: Column) -> Column:
    """One form of a resource prefix: no slash at its end, no doubled slashes after the scheme."""
    scheme = F.regexp_extract(prefix, r"^([a-z]+://)?", 1)
    rest = F.regexp_replace(F.substr(prefix, F.length(scheme) + 1), r"/+", "/")
    return F.concat(scheme, F.rtrim(rest, F.lit("/")))


def joined_prefix(prefix: Column, *parts: Column) -> Column:
    base = normal_prefix(prefix)
    tail = F.concat_ws("/", *(F.trim(p, F.lit("/")) for p in parts))
    return F.when(base.rlike("://$|^$"), F.concat(base, tail)).otherwise(F.concat_ws("/", base, tail))


def overlapping_paths(a: Column, b: Column) -> Column:
    """One is the other or lies below it."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


# ---- configuration text


def int_list(text: Column) -> Column:
    """``1,2`` as whole numbers; null where an item isn't one."""
    items = F.split(text, ",")
    fine = F.forall(items, lambda i: i.rlike(r"^\s*[+-]?\d+\s*$"))
    return F.when(fine, F.transform(items, lambda i: F.trim(i).try_cast("int")))


def int_pairs(text: Column) -> Column:
    """``1,2;3,4`` as pairs; null where a part isn't two whole numbers."""
    pairs = F.transform(F.split(text, ";"), int_list)
    return F.when(F.forall(pairs, lambda p: F.coalesce(F.size(p) == 2, F.lit(False))), pairs)


def assignments(text: Column) -> Column:
    """``a=1,b=2`` as a map of whole numbers."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: F.trim(v).try_cast("int"))


def clamped(value: Column, least: Column, most: Column) -> Column:
    return F.greatest(least, F.least(most, value))


def version(text: Column) -> Column:
    """The leading three numbers of a version, or null."""
    found = F.regexp_extract(text, r"^v?(\d+\.\d+\.\d+)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int")))


def seed(text: Column) -> Column:
    """A seed below 2**31 - 1 from the first eight bytes of the text's SHA-256, big-endian."""
    digest = F.sha2(text.cast("binary"), 256)
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    m = 2147483647  # 2**32 = 2 modulo m
    return F.pmod(F.pmod(high * 2, F.lit(m)) + low, F.lit(m)).cast("int")


def finite_pair(pair: Column) -> Column:
    return F.coalesce((F.size(pair) == 2) & F.forall(pair, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def times_in_order(times: Column) -> Column:
    """All in 0..1 and none below the one before."""
    inside = F.forall(times, lambda t: t.between(0, 1))
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(times) - 1, F.lit(1))), lambda i: F.coalesce(F.get(times, i) >= F.get(times, i - 1), F.lit(True)))
    return F.coalesce(inside & rising, F.lit(False))


# The text of the canonical sheet request, of which %s are filled in.
PROMPT = (
    "Use case: stylized-concept\n"
    "Asset type: production candidate animation sheet for a 2D game\n"
    "Primary request: generate exactly one complete %s animation sheet for %s, facing %s. The sheet contains exactly %s unique poses arranged in a %s-row by %s-column grid, read left-to-right across each row, then continue on the next row.\n"
    "Input images: %s %s\n"
    "Scene/backdrop: genuinely transparent background; if transparency is not possible, use one perfectly flat saturated green background #00ff00 with no texture or gradient\n"
    "Subject: one consistent full-body character only; preserve the same face, hair, costume, weapons, silhouette, proportions, palette, camera distance, and baseline in every cell\n"
    "Style/medium: dense authored native pixel art with crisp hard pixel clusters, no anti-aliasing, no painterly smoothing\n"
    "Composition/framing: every cell has identical dimensions and camera framing; one pose per cell; generous empty margin; feet rest on one shared horizontal ground line; no crop or overlap into neighboring cells\n"
    "Color palette: consistent restrained palette across all cells; no palette drift\n"
    "Constraints: output only the animation sheet, no labels, no numbers, no borders, no UI, no watermark; keep all %s cells populated with distinct poses; preserve equipment attachment points\n"
    "Avoid: checkerboard, black/gray/white backdrop, gradients, glow haze, light matte halo, extra characters, duplicated limbs, missing hands or feet, changing weapon length, front view, three-quarter view, camera zoom changes, random costume changes, interpolated duplicate holds\n"
    "Motion: %s should read as a continuous loop with distinct contact, passing, weight-transfer, and recovery poses while maintaining one identity."
)
REFERENCE = ("Use the supplied identity reference image as Image 1.", "No reference image is supplied; establish one clear identity and keep it fixed.")
GUIDE = ("Use the supplied pose guide as Image 2.", "Design a readable eight-phase motion arc across the cells.")


def prompt(character: Column, clip: Column, frames: Column, direction: Column, rows: Column, columns: Column, reference: Column, guide: Column) -> Column:
    """The request for a sheet; ``reference`` and ``guide`` tell whether such an image is supplied."""
    frames, told = frames.cast("string"), lambda flag, texts: F.when(flag, texts[0]).otherwise(texts[1])
    return F.format_string(PROMPT, clip, character, direction, frames, rows.cast("string"), columns.cast("string"), told(reference, REFERENCE), told(guide, GUIDE), frames, clip)


def extension(engine: Column) -> Column:
    return F.when(engine == "web", ".json").when(engine == "godot", ".tres")


def canonical(*parts: Column) -> Column:
    """A text form of a record that other engines give alike, to be hashed."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
