"""Profiles, templates and options: driver-side documents with strict rules."""

from __future__ import annotations

import json
import math
import re
from pathlib import Path
from types import MappingProxyType


class ConfigurationError(ValueError):
    """A document breaks a rule; the message names the first place in path order."""


def strict_loads(text: str | bytes, unique: bool = False) -> object:
    """JSON without NaN, infinities or numbers that overflow.  Of a repeated key the last value
    counts; with ``unique`` it is an error, and so is a root that is no object."""

    def refuse(token: str) -> None:
        raise ConfigurationError(f"{token} is not allowed")

    def number(token: str) -> float:
        value = float(token)
        if math.isinf(value):
            refuse(token)
        return value

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ConfigurationError("a key occurs twice")
        return dict(pairs)

    value = json.loads(text, parse_constant=refuse, parse_float=number, object_pairs_hook=once if unique else None)
    if unique and not isinstance(value, dict):
        raise ConfigurationError("not an object")
    return value


def check(value: object, rule: object, at: str = "$") -> None:
    """Holds a value against a rule: a type, a set of choices, [rule] for lists, or a dict of members
    (names ending in ? may be absent, ``*`` stands for any name); no other members are allowed."""
    if isinstance(rule, type):
        kinds = (int, float) if rule is float else (rule,)
        if not isinstance(value, kinds) or (isinstance(value, bool) and rule is not bool):
            raise ConfigurationError(f"{at}: not {rule.__name__}")
    elif isinstance(rule, set | frozenset):
        if value not in rule:
            raise ConfigurationError(f"{at}: not one of {sorted(rule)}")
    elif isinstance(rule, list):
        check(value, list, at)
        for k, item in enumerate(value):
            check(item, rule[0], f"{at}[{k}]")
    else:
        check(value, dict, at)
        named = {k.rstrip("?"): r for k, r in rule.items() if k != "*"}
        if "*" not in rule and (extra := sorted(value.keys() - named.keys())):
            raise ConfigurationError(f"{at}.{extra[0]}: unknown")
        for name in sorted(named.keys() | value.keys()):
            if name in value:
                check(value[name], named.get(name, rule.get("*")), f"{at}.{name}")
            elif f"{name}?" not in rule:
                raise ConfigurationError(f"{at}.{name}: missing")


PROFILE = {
    "id": str, "kind": {"character", "prop", "effect"}, "directions": [str],
    "tiers": {"*": {"canvasPolicy": {"fixed", "union"}, "canvas?": [int], "anchor?": [int], "contentMin?": [int], "contentMax?": [int], "padding?": int, "filtering?": {"nearest", "box", "lanczos"}, "downscaleFiltering?": {"nearest", "box", "lanczos"}, "allowUpscale?": bool, "preservePlacement?": bool}},
    "animations": {"*": {"minFrames": int, "maxFrames": int, "fps": float, "loop": bool, "identity?": {"maxHeightDriftRatio?": float, "maxWidthDriftRatio?": float}, "anchor?": {"maxFootDrift": int}}},
    "quality": {
        "alphaThreshold": int, "palette?": {"maxColors": int, "lockAcrossClip?": bool}, "anchor?": {"maxFootDrift": int}, "identity?": {"maxHeightDriftRatio?": float, "maxWidthDriftRatio?": float},
        "edgeMatte?": {"minRgb?": int, "maxChannelSpread?": int, "maxLayers?": int, "maxPixels?": int}, "background?": {"tolerance?": int, "maxRepairableEnclosedComponentPixels?": int, "maxEnclosedTransparentPixels?": int},
    },
    "export": {"engine": {"web", "godot"}, "resourcePrefix": str},
}


def profile(path: str) -> MappingProxyType:
    """A checked, read-only profile; a fixed canvas has to tell its size."""
    value = strict_loads(Path(path).read_text(encoding="utf-8"))
    check(value, PROFILE)
    for name, tier in sorted(value["tiers"].items()):
        if tier["canvasPolicy"] == "fixed" and "canvas" not in tier:
            raise ConfigurationError(f"$.tiers.{name}.canvas: missing")
    for name, clip in sorted(value["animations"].items()):
        if not 0 < clip["minFrames"] <= clip["maxFrames"] or not 0 < clip["fps"] < math.inf:
            raise ConfigurationError(f"$.animations.{name}: frames or speed out of range")
    return MappingProxyType(value)


def profiles(folder: str) -> dict[str, MappingProxyType]:
    """All good profiles of a folder; schemas and broken ones are passed over."""
    out = {}
    for path in sorted(Path(folder).glob("*.json")):
        if not path.name.endswith(".schema.json"):
            try:
                out[path.stem] = profile(str(path))
            except (ConfigurationError, ValueError, OSError):
                continue
    return out


TOKEN = re.compile(r"\$\{([A-Z][A-Z0-9_]*)\}")


def substituted(value: object, tokens: dict[str, object]) -> object:
    """A document with ``${TOKEN}`` replaced; a string that is one token takes the value with its type."""
    if isinstance(value, dict):
        return {k: substituted(v, tokens) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, tokens) for v in value]
    if isinstance(value, str):
        if (whole := TOKEN.fullmatch(value)) and whole[1] in tokens:
            return tokens[whole[1]]
        return TOKEN.sub(lambda m: str(tokens[m[1]]) if m[1] in tokens else m[0], value)
    return value


def unresolved(value: object) -> list[str]:
    """Tokens that are still in a document."""
    if isinstance(value, dict):
        return sorted({t for v in value.values() for t in unresolved(v)})
    if isinstance(value, list):
        return sorted({t for v in value for t in unresolved(v)})
    return sorted(set(TOKEN.findall(value))) if isinstance(value, str) else []


def overlaid(defaults: dict[str, float], overrides: dict[str, float]) -> dict[str, float]:
    """Defaults with overrides of known names and finite values."""
    for name, value in sorted(overrides.items()):
        if name not in defaults:
            raise ConfigurationError(f"{name}: unknown")
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
            raise ConfigurationError(f"{name}: not a finite number")
    return defaults | overrides


def short_float(value: float) -> str:
    """Twelve significant digits, without trailing zeros."""
    return format(value, ".12g")
