"""Stages on characters: Unicode normalisation, agent artifacts, and secrets."""

from __future__ import annotations

import re
import unicodedata

from ..functions.chars import EM_DASH, INVISIBLE, MOJIBAKE, PLAIN, RECORDING_DOT, SECRETS, WHITE, n_bytes, trim
from .base import Context, Stage

_DOT = re.compile(rf"(?m)^([{WHITE.replace(chr(10), '')}]*){RECORDING_DOT}+[{WHITE.replace(chr(10), '')}]*")
_ANSI = re.compile(r"\x1B\[[0-9;]*[A-Za-z]")
_SECRETS = tuple((name, re.compile(p.removesuffix("$") + r"\Z" if p.endswith("$") else p)) for name, p in SECRETS)


def repair_mojibake(text: str) -> tuple[str, int]:
    """Repairs paragraphs with three patterns or more; and the number of patterns in those."""
    out, repairs = [], 0
    for paragraph in text.split("\n\n"):
        hits = sum(bad in paragraph for bad, _ in MOJIBAKE)
        if hits >= 3:
            repairs += hits
            for bad, good in MOJIBAKE:
                paragraph = paragraph.replace(bad, good)
        out.append(paragraph)
    return "\n\n".join(out), repairs


def unicode_stage(em_dash: str = "--") -> Stage:
    """em_dash: what stands for an em dash; empty keeps it."""
    table = str.maketrans(PLAIN | dict.fromkeys(INVISIBLE) | ({EM_DASH: em_dash} if em_dash else {}))

    def run(text: str, ctx: Context) -> str:
        out, repairs = repair_mojibake(text)
        if repairs:
            ctx.fired("normalize_unicode", f"repaired {repairs} mojibake sequences", repairs)
        out = unicodedata.normalize("NFC", out.translate(table))
        if changed := abs(n_bytes(out) - n_bytes(text)) or int(out != text):
            ctx.fired("normalize_unicode", f"normalized {changed} bytes of unicode content", changed)
        return out

    return run


def artifact_stage(text: str, ctx: Context) -> str:
    out = _DOT.sub(r"\1", _ANSI.sub("", text)).translate(dict.fromkeys(map(ord, INVISIBLE)))
    if (gone := n_bytes(text) - n_bytes(out)) > 0:
        ctx.fired("agent_strip", f"removed {gone} bytes of agent artifacts", gone)
    return out


def secret_in(text: str) -> str | None:
    """The name of the first pattern that the trimmed text matches."""
    own = trim(text)
    return next((name for name, p in _SECRETS if p.search(own)), None)
