"""Structure: JSON is printed prettily, delimited lines become a Markdown table, code gets a fence."""

from __future__ import annotations

import re

from ..functions.chars import FENCE, KEYWORDS, is_fence, lines_of, n_bytes, trim
from .base import CODE, JSON, LIST, SHELL, TABLE, Context
from .classify import is_sentence_end, percent
from .strict_json import dump, parse
from .tables import _usual, split_delimited

#: Output beyond so many times the input's bytes is refused.
MOST_RATIO = 2.0
_NUMBER = re.compile(r"[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)", re.I)
_DELIMITERS = {"\t": "tab", ",": "comma", ";": "semicolon"}


def pretty_json(own: str, flat: bool = False) -> str | None:
    found = parse(own)
    if found is None or not isinstance(found.value, dict | list):
        return None
    out = dump(found.value, None if flat else 2)
    return out if n_bytes(out) <= MOST_RATIO * n_bytes(own) else None


def is_header(cells: list[str]) -> bool:
    """Distinct cells, under 80 per cent numbers."""
    return len(set(cells)) == len(cells) and percent(sum(_NUMBER.fullmatch(trim(c)) is not None for c in cells), len(cells)) < 80


def markdown_of(rows: list[list[str]]) -> str:
    width = len(rows[0])
    head, body = (rows[0], rows[1:]) if is_header(rows[0]) else ([f"Col {i}" for i in range(1, width + 1)], rows)
    return "\n".join(f"| {' | '.join(map(trim, r))} |" for r in [head, ["---"] * width, *body])


def delimited_to_markdown(lines: list[str], delimiter: str) -> str | None:
    split = [split_delimited(line, delimiter) for line in lines]
    usual, count = _usual([len(r) for r in split])
    if usual < 2 or percent(count, len(split)) < 80:
        return None
    return markdown_of([r for r in split if len(r) == usual])


def language_of(text: str) -> str | None:
    """The language of most keywords, with two at least; of equals the later one."""
    scores = [(sum(text.count(k) for k in words), i, name) for i, (name, words) in enumerate(KEYWORDS.items())]
    best = max(scores)
    return best[2] if best[0] >= 2 else None


def code_score(filled: list[str], language: str | None) -> int:
    share = lambda test: percent(sum(map(test, filled)), len(filled))
    return (share(lambda x: x[0] in " \t") >= 40) + (language is not None) + (share(lambda x: any(c in x for c in "{};")) >= 15) - 2 * (share(is_sentence_end) >= 30)


# What the stage says in the context.
SAID_JSON, SAID_TABLE, SAID_CODE = "prettified JSON", "converted {}-delimited data to Markdown table", "wrapped code block"


def structure_stage(text: str, ctx: Context) -> str:
    own = trim(text)
    if ctx.content_type in (SHELL, LIST) or (own.startswith(FENCE) and own.endswith(FENCE)):
        return text
    if (out := pretty_json(own)) is not None:
        ctx.content_type = JSON
        ctx.fired("structural_detection", SAID_JSON, abs(n_bytes(out) - n_bytes(own)))
        return out
    lines = lines_of(own)
    if len(lines) >= 2:
        for delimiter, name in _DELIMITERS.items():
            if (out := delimited_to_markdown(lines, delimiter)) is not None:
                if n_bytes(out) > MOST_RATIO * n_bytes(text):
                    break  # a later delimiter isn't tried
                ctx.content_type = TABLE
                ctx.fired("structural_detection", SAID_TABLE.format(name), abs(n_bytes(out) - n_bytes(text)))
                return out
    filled = [line for line in lines if line]
    if len(lines) <= 3 or not filled or any(map(is_fence, lines)):
        return text
    language = language_of(own)
    if not own.startswith("#!") and code_score(filled, language) < 2:
        return text
    ctx.content_type = CODE
    ctx.fired("structural_detection", SAID_CODE + (f" ({language})" if language else ""), 6 + len(language or ""))
    return f"{FENCE}{language or ''}\n{own}\n{FENCE}"
