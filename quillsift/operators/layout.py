"""Whitespace and line breaks: hard-wrapped prose is unwrapped; lists, commands and code fences keep their lines."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from typing import NamedTuple

from ..functions.chars import RECORDING_DOT, SHELL_WORDS, WHITE, WORD, is_fence, trim, words_of
from .base import SHELL, Context

_ANY_WHITE = f"[{WHITE}]"
_LIST = re.compile(rf"- |\* |[•◦▪]{_ANY_WHITE}|\d+[.)\]] ")
_LIST_STARTS = frozenset("-*•◦▪") | {chr(c) for c in range(sys.maxunicode) if chr(c).isdecimal()}
_BULLET = re.compile(rf"([•◦▪]){_ANY_WHITE}+")
_SPACES = re.compile(" {3,}")
#: Leading blanks beyond this are padding, and begin a paragraph.
MOST_INDENT = 20
#: Lines up to this length say nothing about the width of the terminal; lengths within SPREAD are one width.
SHORT_LINE, SPREAD = 40, 4


class Line(NamedTuple):
    text: str
    indent: int
    raw_len: int


def is_list_item(line: str) -> bool:
    return line[:1] in _LIST_STARTS and _LIST.match(line) is not None


def is_shell_command(line: str) -> bool:
    """A known command with an argument that looks like one (a flag, a path, a variable), or a script by its path."""
    own = trim(line)
    if len(own.encode()) > 2 and own[0] == own[-1] == "`":
        own = own[1:-1]
    first = WORD.match(own, len(own) - len(own.lstrip(WHITE)))
    if first is None or not (first[0] in SHELL_WORDS or first[0].startswith("./")):
        return False
    words = words_of(own)
    command = (words[1] if len(words) > 1 else "") if words[0] == "sudo" else words[0]
    if command.startswith("./"):
        return True
    return command in SHELL_WORDS and any("/" in w or w[0] in "~$" or (w[0] == "-" and len(w) > 1) for w in words[1:])


def terminal_width(lines: list[str]) -> int:
    """The upper end of the largest cluster of line lengths, 0 without three lines of about one length."""
    sizes = sorted(n for line in lines if (n := len(line.rstrip(WHITE))) > SHORT_LINE)
    most, width = 0, 0
    for i, n in enumerate(sizes):
        end = bisect_right(sizes, n + SPREAD)
        if end - i > most or (end - i == most and n > width):
            most, width = end - i, sizes[end - 1]
    return width if most >= 3 else 0


def squeeze(raw: str) -> tuple[str, bool]:
    """A line without trailing blanks and wide gaps; and whether it was padded so far that a paragraph begins."""
    line = raw.rstrip(WHITE)
    body = line.lstrip(" \t")
    lead = line[: len(line) - len(body)]
    if not body:
        return line, False
    padded = len(lead) > MOST_INDENT
    return ("" if padded else lead) + _SPACES.sub(" ", body), padded


def marked(line: str) -> Line:
    """Text and indent of a line, with one spelling of bullets and without recording dots."""
    text = line.lstrip(WHITE)
    indent = sum(4 if c == "\t" else 1 for c in line[: len(line) - len(text)])
    if text.startswith(RECORDING_DOT):
        text = text.lstrip(RECORDING_DOT).lstrip(WHITE)
    if bullet := _BULLET.match(text):
        indent += 2 * (bullet[1] != "•")
        text = "- " + text[bullet.end() :]
    return Line(text, indent, 0)


def joined_commands(lines: list[Line]) -> list[Line]:
    """Lines that end with a backslash take in the next."""
    out: list[Line] = []
    going = False
    for line in lines:
        more = line.text.endswith("\\")
        text = line.text[:-1].rstrip(WHITE) if more else line.text
        if going:
            out[-1] = out[-1]._replace(text=f"{out[-1].text} {text.lstrip(WHITE)}")
        else:
            out.append(line._replace(text=text))
        going = more
    return out


def paragraph(lines: list[Line], width: int = 0) -> str:
    """The lines of a paragraph, unwrapped."""
    lines = joined_commands(lines)
    base = min((x.indent for x in lines), default=0)
    out: list[str] = []
    prose: list[str] = []  # the words of the running text, line by line
    last_len, item_indent = 0, 0

    def end_prose() -> None:
        if prose:
            out.append(" ".join(prose))
            prose.clear()

    for text, indent, raw_len in lines:
        rel = indent - base
        if is_list_item(text):
            end_prose()
            last_len, item_indent = 0, rel
            out.append(" " * rel + text)
        elif is_shell_command(text):
            end_prose()
            last_len = 0
            out.append(text)
        elif not prose and out and is_list_item(out[-1].lstrip(WHITE)) and rel >= item_indent:
            out[-1] += f" {text}"
        else:
            first = words_of(text)
            meant = width and last_len and first and last_len + 1 + len(first[0]) < width  # the word would have fitted
            if prose and (prose[-1].endswith(":") or meant):
                end_prose()
            prose.append(text)
            last_len = raw_len
    end_prose()
    return "\n".join(out)


def _unix(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def unwrap(text: str) -> str:
    raw_lines = _unix(text)
    width = terminal_width(raw_lines)
    blocks: list[str] = []
    group: list[Line] = []
    fence: list[str] | None = None
    fence_indent = ""

    def end_group() -> None:
        if group and (block := paragraph(group, width)):
            blocks.append(block)
        group.clear()

    for raw in raw_lines:
        if fence is not None:
            closes = is_fence(raw)
            fence.append(trim(raw) if closes else raw.removeprefix(fence_indent))
            if closes:
                blocks.append("\n".join(fence))
                fence = None
            continue
        line, padded = squeeze(raw)
        if is_fence(line):
            end_group()
            fence, fence_indent = [trim(line)], line[: len(line) - len(line.lstrip(" \t"))]
            continue
        own = marked(line)
        if padded or not own.text:
            end_group()
        if own.text:
            group.append(own._replace(raw_len=len(raw.rstrip(WHITE))))
    end_group()
    if fence:
        blocks.append("\n".join(fence))
    return "\n\n".join(blocks)


def layout_stage(text: str, ctx: Context) -> str:
    if ctx.content_type == SHELL:  # commands keep their lines
        return trim("\n".join(x.text for x in joined_commands([marked(line) for line in _unix(text)])))
    return unwrap(text)
