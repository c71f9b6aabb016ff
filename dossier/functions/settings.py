"""Settings as nested dicts, and how values are shown (CFG2, FMT1, TXT13)."""

from __future__ import annotations

import re
from typing import Any


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Objects merge by key, null sets nothing, other values replace."""
    out = dict(base)
    for key, value in over.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merged(out[key], value)
        elif value is not None:
            out[key] = value
    return out


def difference(base: dict[str, Any], changed: dict[str, Any]) -> dict[str, Any]:
    """The least dict that merged into base gives changed."""
    out: dict[str, Any] = {}
    for key, value in changed.items():
        if isinstance(value, dict) and isinstance(base.get(key), dict):
            if inner := difference(base[key], value):
                out[key] = inner
        elif key not in base or base[key] != value:
            out[key] = value
    return out


def unknown_keys(base: dict[str, Any], over: dict[str, Any], path: str = "") -> list[str]:
    """Dotted paths of keys that base doesn't have."""
    out = []
    for key, value in over.items():
        here = f"{path}.{key}" if path else key
        if key not in base:
            out.append(here)
        elif isinstance(value, dict) and isinstance(base[key], dict):
            out += unknown_keys(base[key], value, here)
    return out


def phrase_pattern(phrases: list[str]) -> str:
    """TXT13: one pattern for label phrases, longest first: white space is free beside signs, dots may lack, * is a word."""

    def one(phrase: str) -> str:
        out = []
        for n, word in enumerate(phrase.split()):
            if n:
                before = phrase.split()[n - 1]
                out.append(r"\s*" if not (before[-1].isalnum() and word[0].isalnum()) else r"\s+")
            out.append(r"\S+" if word == "*" else re.escape(word).replace(r"\.", r"\.?"))
        return "".join(out)

    return "|".join(one(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))


def percent(share: float | None) -> str:
    return "–" if share is None else f"{share * 100:.0f} %"


def duration(seconds: float) -> str:
    if seconds < 1:
        return f"{seconds * 1000:.0f} ms"
    if seconds < 60:
        return f"{seconds:.1f} s"
    return f"{int(seconds // 60)} min {int(seconds % 60)} s"
