"""What a text is: JSON, a table, a URL, shell commands, code, a list, prose, or mixed."""

from __future__ import annotations

from ..functions.chars import lines_of, trim
from .base import CODE, JSON, LIST, MIXED, PROSE, SHELL, TABLE, URL
from .layout import is_list_item, is_shell_command
from .strict_json import parse
from .tables import extract_table


def percent(part: int, whole: int) -> int:
    return part * 100 // whole if whole else 0


def is_sentence_end(line: str) -> bool:
    return trim(line).endswith((".", "?", "!"))


def is_single_url(own: str) -> bool:
    return own.startswith(("http://", "https://")) and "\n" not in own and " " not in own


def is_shell_line(line: str) -> bool:
    own = trim(line)
    if not own or own.startswith(("#!", "# ", "$ ")) or own.endswith("\\"):
        return True
    if own.startswith("--"):
        return own[2:3].isascii() and own[2:3].isalnum()
    return (own[0] == "-" and len(own) > 1 and own[1] != " ") or is_shell_command(own)


def looks_like_code(own: str, lines: list[str], filled: list[str]) -> bool:
    if len(lines) <= 3:
        return False
    indented = percent(sum(line[0] in " \t" for line in filled), len(filled))
    return own.startswith("#!") or (indented >= 40 and percent(sum(map(is_sentence_end, filled)), len(filled)) < 30)


def classify(text: str) -> str:
    own = trim(text)
    if parse(own) is not None:
        return JSON
    if extract_table(own).detected:
        return TABLE
    if is_single_url(own):
        return URL
    lines = lines_of(own)
    filled = [line for line in lines if line]
    if filled and all(map(is_shell_line, filled)):
        return SHELL
    if looks_like_code(own, lines, filled):
        return CODE
    if len(filled) >= 2 and percent(sum(is_list_item(trim(line)) for line in filled), len(filled)) >= 60:
        return LIST
    return PROSE if len(lines) <= 2 else MIXED
