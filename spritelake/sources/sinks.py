"""Writers: registries, resources, manifests, and publishing a folder in one step."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = ".spritelake-owned"


class PublishError(RuntimeError):
    """The destination isn't ours, is in use, or changed under us."""


def registry(frames: DataFrame) -> DataFrame:
    """character, json: tiers, clips and directions with their ordered paths, nested."""

    paths = frames.groupBy("character", "tier", "clip", "direction").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "path")))["path"]).alias("json"))
    for keys, key in ((["character", "tier", "clip"], "direction"), (["character", "tier"], "clip"), (["character"], "tier")):
        quoted = F.to_json(F.array(key))
        member = F.concat(F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), "json")
        paths = paths.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(member)), ","), F.lit("}")).alias("json"))
    return paths.select("character", "json")


def sprite_resources(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """clip, text: a text resource for each clip (clip, loop, fps) with its frames (clip, seq, path) in order.

    The head counts the textures, which are numbered from 1; the one animation refers to them by
    number.  One row holds what one file holds.
    """
    per = frames.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("seq", "path")))["path"].alias("paths")).join(clips, "clip")
    number = lambda i: (i + 1).cast("string")
    textures = F.transform("paths", lambda p, i: F.concat(F.lit('[ext_resource type="Texture2D" path="'), p, F.lit('" id="'), number(i), F.lit('"]')))
    shown = F.transform("paths", lambda _, i: F.concat(F.lit('{"duration": 1.0, "texture": ExtResource("'), number(i), F.lit('")}')))
    speed = F.col("fps").cast("double").cast("string")
    text = F.concat(
        F.lit('[gd_resource type="SpriteFrames" load_steps='), (F.size("paths") + 1).cast("string"), F.lit(" format=3]\n\n"), F.array_join(textures, "\n"), F.lit('\n\n[resource]\nanimations = [{\n"frames": ['),
        F.array_join(shown, ", "), F.lit('],\n"loop": '), F.col("loop").cast("string"), F.lit(',\n"name": &"'), "clip", F.lit('",\n"speed": '), speed, F.lit("\n}]\n"),
    )
    return per.select("clip", text.alias("text"))


def canonical_json(value: object) -> bytes:
    """Sorted keys, no spaces; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def tree_files(folder: str) -> list[dict]:
    """path, bytes and sha256 of each file, sorted by path; links are errors."""
    out = []
    for path in sorted(Path(folder).rglob("*")):
        if path.is_symlink():
            raise PublishError(f"{path} is a link")
        if path.is_file() and path.name != MARKER:
            h = hashlib.sha256()
            with path.open("rb") as f:
                while block := f.read(1 << 20):
                    h.update(block)
            out.append({"path": path.relative_to(folder).as_posix(), "bytes": path.stat().st_size, "sha256": h.hexdigest()})
    return out


def write_new(path: str, data: bytes) -> None:
    """Creates a file that must not be there yet, whole and synced."""
    with open(path, "xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


def write_whole(path: str, data: bytes) -> None:
    """Replaces a file in one step."""
    new = f"{path}.{uuid.uuid4().hex}"
    write_new(new, data)
    os.replace(new, path)


@contextlib.contextmanager
def locked(destination: str) -> Iterator[None]:
    """Keeps other publishers away; fails at once if one is at work."""
    path = Path(f"{destination.rstrip('/')}.lock")
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as error:
            raise PublishError(f"{destination} is being published") from error
        yield


def publish(stage: str, destination: str, finalize: Callable[[], None] | None = None) -> list[dict]:
    """Puts a staged folder in the place of ``destination`` in one step and returns its files.

    Only a missing, empty or own folder (it holds the marker) is replaced; what was there comes
    back if anything fails, ``finalize`` included.
    """
    dest = Path(destination)
    if dest.is_symlink() or (dest.exists() and not dest.is_dir()):
        raise PublishError(f"{dest} is not a folder")
    with locked(destination):
        if dest.exists() and any(dest.iterdir()) and not (dest / MARKER).exists():
            raise PublishError(f"{dest} holds files of others")
        files = tree_files(stage)
        (Path(stage) / MARKER).touch()
        backup = dest.with_name(f".{dest.name}.{uuid.uuid4().hex}")
        had = dest.exists()
        if had:
            os.replace(dest, backup)
        try:
            os.replace(stage, dest)
            if tree_files(destination) != files:
                raise PublishError("files changed while they were published")
            if finalize:
                finalize()
        except BaseException:
            shutil.rmtree(dest, ignore_errors=True)
            if had:
                os.replace(backup, dest)
            raise
        shutil.rmtree(backup, ignore_errors=True)
    return files


def sync_plan(incoming: DataFrame, existing: DataFrame, key: str = "name", sha: str = "sha256") -> DataFrame:
    """key, action: add, replace, keep or delete."""
    both = incoming.select(key, F.col(sha).alias("new")).join(existing.select(key, F.col(sha).alias("old")), key, "full_outer")
    action: Column = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "add").when(F.col("new") == F.col("old"), "keep").otherwise("replace")
    return both.select(key, action.alias("action"))


def release(frames: list[dict], clips: dict[str, dict]) -> dict:
    """A release manifest: clips with their frames, all files, and the fingerprint of both."""
    body = {"schemaVersion": 1, "clips": clips, "files": sorted(frames, key=lambda f: f["path"])}
    return body | {"releaseFingerprint": digest(body)}


def release_faults(manifest: dict, folder: str) -> list[str]:
    """What a published folder lacks or has changed against its manifest."""
    want, have = {f["path"]: f["sha256"] for f in manifest["files"]}, {f["path"]: f["sha256"] for f in tree_files(folder)}
    body = {k: v for k, v in manifest.items() if k != "releaseFingerprint"}
    out = [] if digest(body) == manifest.get("releaseFingerprint") else ["fingerprint"]
    out += [f"missing: {p}" for p in sorted(want.keys() - have.keys())] + [f"unexpected: {p}" for p in sorted(have.keys() - want.keys())]
    return out + [f"changed: {p}" for p in sorted(want.keys() & have.keys()) if want[p] != have[p]]
