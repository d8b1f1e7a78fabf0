"""JSON as a strict parser reads it, pretty and flat printing with sorted keys."""

from __future__ import annotations

import json
import math
import re

DEPTH = 128
_LONE = re.compile("[\ud800-\udfff]")


class Parsed:
    """A parsed value; a class of its own, so that null is not `no value`."""

    def __init__(self, value: object):
        self.value = value


def _refuse(name: str):
    raise ValueError(name)


def _integer(digits: str) -> int | float:
    n = int(digits)
    return n if -(2**63) <= n < 2**64 and digits != "-0" else _real(digits)


def _real(digits: str) -> float:
    if math.isinf(x := float(digits)):
        raise ValueError("number out of range")
    return x


def _check(value: object, depth: int) -> None:
    if isinstance(value, dict | list):
        if depth >= DEPTH:
            raise ValueError("too deep")
        for x in [*value, *value.values()] if isinstance(value, dict) else value:
            _check(x, depth + 1)
    elif isinstance(value, str) and _LONE.search(value):
        raise ValueError("lone surrogate")


def parse(text: str) -> Parsed | None:
    """The value, or None if text isn't one JSON value: no NaN, no numbers out of range, at most DEPTH levels, last of equal keys."""
    if text[:1] not in '{["-0123456789tfn' or not text:
        return None
    try:
        value = json.loads(text, parse_constant=_refuse, parse_int=_integer, parse_float=_real)
        _check(value, 0)
    except (ValueError, RecursionError):
        return None
    return Parsed(value)


def _number(x: float) -> str:
    mantissa, _, exponent = repr(x).partition("e")
    return f"{mantissa}e{int(exponent)}" if exponent else mantissa


def dump(value: object, indent: int | None = 2, level: int = 0) -> str:
    """Keys in code point order; indent None: flat."""
    if isinstance(value, dict | list) and value:
        items = [f"{json.dumps(k, ensure_ascii=False)}:{'' if indent is None else ' '}{dump(value[k], indent, level + 1)}" for k in sorted(value)] if isinstance(value, dict) else [dump(x, indent, level + 1) for x in value]
        opening, closing = "{}" if isinstance(value, dict) else "[]"
        if indent is None:
            return opening + ",".join(items) + closing
        gap = "\n" + " " * (indent * (level + 1))
        return opening + gap + f",{gap}".join(items) + "\n" + " " * (indent * level) + closing
    return _number(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)
