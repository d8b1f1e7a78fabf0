"""Tables in text: terminal boxes, boxes that lost their line breaks, aligned pipes, Markdown, and delimited lines."""

from __future__ import annotations

import re
from collections import Counter
from itertools import accumulate
from dataclasses import dataclass, field

import numpy as np

from ..functions.chars import BARS, BOX, WHITE, lines_of, trim

TABLE_DDL = "struct<detected:boolean,format:string,confidence:float,rows:array<array<string>>,warnings:array<string>>"
#: Bytes by which the bars of a column may stand apart in lines that count as aligned.
DRIFT = 6
_BAR = re.compile(f"[{BARS}]")
_BORDER, _ALNUM, _SEPARATOR = re.compile(f"[{BOX}]"), re.compile(r"[^\W_]"), re.compile("[\x1c-\x1f]")
_DASHES = re.compile(r":*-{3,}:*")


@dataclass
class Table:
    detected: bool = False
    format: str | None = None
    confidence: float = 0.0
    rows: list[list[str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def gated(self, enabled: bool = True, least: float = 0.75) -> Table:
        if not enabled:
            return Table(False, None, self.confidence, [], [*self.warnings, "table picker disabled by configuration"])
        if self.detected and np.float32(self.confidence) < np.float32(least):
            return Table(False, None, self.confidence, [], [*self.warnings, f"table confidence {self.confidence:.2f} below threshold {least:.2f}"])
        return self


def _found(kind: str, confidence: float, rows: list[list[str]], warnings: list[str] | None = None) -> Table:
    return Table(True, kind, float(np.clip(np.float32(confidence), np.float32(0), np.float32(0.99))), rows, warnings or [])


def _sum32(*parts: float) -> np.float32:
    out = np.float32(0)
    for p in parts:
        out = np.float32(out + np.float32(p))
    return out


def _usual(sizes: list[int]) -> tuple[int, int]:
    """The most frequent size (the larger one of a tie) and its count; (0, 0) of none."""
    return max(((n, c) for n, c in Counter(sizes).items()), key=lambda x: (x[1], x[0]), default=(0, 0))


def bars_in(line: str) -> list[int]:
    return [m.start() for m in _BAR.finditer(line)] if "|" in line or "│" in line else []


def is_rule(line: str) -> bool:
    """A line of borders only."""
    if _ALNUM.search(line) or not (own := trim(line)):
        return False
    return _BORDER.search(own) is not None or not own.strip("+-| ")


def blanks_of(text: str) -> str | None:
    """What to strip from the parts of a text: None, Python's own blanks and the faster ones, unless the text has separators among them."""
    return WHITE if _SEPARATOR.search(text) else None


def cells_between_bars(line: str, blanks: str | None = WHITE) -> list[str]:
    return [c.strip(blanks) for c in line.replace("│", "|").split("|")[1:-1]]


def split_delimited(line: str, delimiter: str) -> list[str]:
    """Fields of a line; quotes may open anywhere, a doubled quote inside them is one."""
    if '"' not in line:
        return line.split(delimiter)
    parts = line.split('"')
    fields, last = parts[0].split(delimiter), len(parts) - 1
    for i in range(1, last + 1):
        own = parts[i]
        if i % 2:
            fields[-1] += own
        elif not own:  # nothing between two quotes: a doubled one
            if i < last:
                fields[-1] += '"'
        else:
            first, *more = own.split(delimiter)
            fields[-1] += first
            fields += more
    return fields


def _bars_of(lines: list[str]) -> list[int]:
    """How many bars each line has."""
    return [line.count("|") + line.count("│") for line in lines]


def _with_left_border(lines: list[str]) -> list[str]:
    """Lines whose left border was cut off get it back."""
    bars = _bars_of(lines)
    starts = [n >= 2 and (line[0] in BARS or line.lstrip(WHITE)[0] in BARS) for line, n in zip(lines, bars, strict=True)]
    usual, _ = _usual([n for n, s in zip(bars, starts, strict=True) if s and n >= 3])
    if not usual:
        return lines
    return [f"│ {line.lstrip(WHITE)}" if n + 1 == usual and n >= 2 and not s else line for line, n, s in zip(lines, bars, starts, strict=True)]


def terminal_box(text: str) -> Table | None:
    """Rows are what stands between borders; the lines of a row are joined cell by cell."""
    lines = _with_left_border(lines_of(text))
    if len(lines) < 2:
        return None
    rows: list[list[list[str]]] = []
    warnings: list[str] = []
    width = cell_lines = 0
    ruled, fresh, blanks, written = False, True, blanks_of(text), _ALNUM.search
    rules: dict[str, bool] = {}  # borders repeat
    for line in lines:
        if written(line) is None:
            if (rule := rules.get(line)) is None:
                rule = rules[line] = is_rule(line)
            if rule:
                ruled = fresh = True
                continue
        cells = [c.strip(blanks) for c in line.replace("│", "|").split("|")[1:-1]]
        if len(cells) < 2:
            continue
        cell_lines += 1
        width = width or len(cells)
        if len(cells) != width:
            warnings.append(f"line had {len(cells)} columns, expected {width}")
            cells = (cells + [""] * width)[:width]
        if fresh:
            rows.append([cells])
            fresh = False
        else:
            rows[-1].append(cells)
    joined = [row[0] if len(row) == 1 else [" ".join(filter(None, column)) for column in zip(*row, strict=True)] for row in rows]
    filled = [row for row in joined if any(row)]
    if not filled or width < 2 or (len(filled) == 1 and not ruled and cell_lines < 2):
        return None
    return _found("terminal", _sum32(0.72, 0.12 * ruled, 0.08 * (cell_lines >= len(filled)), -0.1 * bool(warnings)), filled, warnings)


def _column_hint(text: str) -> int:
    for line in map(trim, lines_of(text)):
        if not _ALNUM.search(line) and _BORDER.search(line) and (splits := sum(c in "┬┼┴" for c in line)):
            return splits + 1
    return 0


def flattened_box(text: str) -> Table | None:
    """A box whose line breaks were lost: they are put back at borders and after each full set of bars."""
    lines = lines_of(text)
    bars = _bars_of(lines)
    if sum(bars) < 6:
        return None
    dense = any(n >= 6 for n in bars) or any(n and any(c in line for c in "├┤┼└┌") for n, line in zip(bars, lines, strict=True))
    if not (len(lines) <= 2 or dense or any(x in text for x in ("│ │", "| |", "│ ├", "┤ │"))):
        return None
    out = text.replace("│ │", "│\n│")
    out = re.sub(r" │ (?=[├└┌])", " │\n", out)
    out = re.sub(r"([┤┼┘┐]) (?=│)", r"\1\n", out)
    white = f"[{WHITE}]+"
    out = re.sub(rf"([│|]){white}([├└┌┬┴┼])", r"\1\n\2", out)
    out = re.sub(rf"([┤┼┘┐]){white}([│|])", r"\1\n\2", out)
    each = _column_hint(text) + 1
    rebuilt: list[str] = []
    own = lines_of(out)
    for line, n in zip(own, _bars_of(own), strict=True):
        if each >= 3 and n >= 2 * each and n % each == 0:
            at = bars_in(line)
            rebuilt += [line[at[i] : at[i + each - 1] + 1] for i in range(0, n, each)]
        else:
            rebuilt.append(line)
    out = "\n".join(rebuilt)
    if out == text or (box := terminal_box(out)) is None:
        return None
    return _found("terminal", _sum32(box.confidence, -0.08), box.rows, [*box.warnings, "reconstructed flattened terminal rows"])


def _bars_at(line: str) -> list[int]:
    """The bytes at which the bars of a line stand."""
    if "|" in line and "│" in line:
        return [len(line[:i].encode()) for i in bars_in(line)]
    bar = "|" if "|" in line else "│"
    size = len(bar.encode())
    return [at - size for at in accumulate([len(p.encode()) + size for p in line.split(bar)[:-1]])]


def aligned_pipes(text: str) -> Table | None:
    lines = [line.rstrip(WHITE) for line in lines_of(text) if trim(line)]
    bars = _bars_of(lines)
    usual, count = _usual([n for n in bars if n >= 3])
    if len(lines) < 2 or count < 2:
        return None
    own = [line for line, n in zip(lines, bars, strict=True) if n == usual]
    if any(max(slot) - min(slot) > DRIFT for slot in zip(*map(_bars_at, own), strict=True)):
        return None
    blanks = blanks_of(text)
    rows = [cells for line in own if not is_rule(line) and len(cells := cells_between_bars(line, blanks)) >= 2]
    if len(rows) < 2 or sum(any(column) for column in zip(*rows, strict=True)) < 2:
        return None
    confidence = _sum32(0.68, 0.05 * (len(own) >= 3), 0.03 * ("│" in text), -0.06 * any(c in text for c in "├┼┤"))
    return _found("terminal", confidence, rows, ["inferred table from aligned pipe columns"])


_CELL = re.compile(r"((?:\\.|[^\\|])*)(\||\\?\Z)", re.S)


def _markdown_cells(line: str, blanks: str | None = WHITE) -> list[str]:
    own = line.removeprefix("|").removesuffix("|")
    if "\\" not in own:
        return [c.strip(blanks) for c in own.split("|")]
    if "\0" not in own and own.removesuffix("\\").count("\\") == own.count("\\|"):  # bars alone are escaped
        return [c.replace("\0", "|").strip(blanks) for c in own.removesuffix("\\").replace("\\|", "\0").split("|")]
    out = []
    for m in _CELL.finditer(own):
        out.append(trim(re.sub(r"(?s)\\(.)", r"\1", m[1])))
        if m[2] != "|":
            break
    return out


def markdown_table(text: str) -> Table | None:
    if text.count("|") < 2:
        return None
    barred, blanks = [line for line in lines_of(text) if "|" in line], blanks_of(text)
    if len(barred) < 2:
        return None
    grid = [cells for line in barred if len(cells := _markdown_cells(trim(line), blanks)) >= 2]
    body = [row for row in grid if not all(_DASHES.fullmatch(c) for c in row)]
    rows = [row for row in body if len(row) == len(body[0])]
    if len(rows) < 2:
        return None
    return _found("markdown", 0.93 if len(body) < len(grid) else 0.78, rows)


def delimited(text: str) -> Table | None:
    """Tab, comma or semicolon; comma needs three columns, as prose has commas."""
    lines = [own for line in lines_of(text) if (own := trim(line))]
    if len(lines) < 2:
        return None
    for delimiter, least, confidence in DELIMITERS:
        if text.count(delimiter) * 100 < 80 * (least - 1) * len(lines):  # too few, wherever they stand
            continue
        split = [split_delimited(line, delimiter) for line in lines]
        usual, count = _usual([len(r) for r in split])
        if usual >= least and count * 100 // len(split) >= 80 and count >= 2:
            return _found("delimiter", confidence, [r for r in split if len(r) == usual])
    return None


DELIMITERS = (("\t", 2, 0.92), (",", 3, 0.84), (";", 2, 0.83))
#: The parsers, each with the most that its tables can be sure of.
PARSERS = ((terminal_box, 0.92), (flattened_box, 0.84), (aligned_pipes, 0.76), (markdown_table, 0.93), (delimited, 0.92))


def extract_table(text: str) -> Table:
    """The table that is surest (then largest, then of the later parser)."""
    own = trim(text)
    if not own:
        return Table()
    barred, best, most = "|" in own or "│" in own, Table(), (np.float32(-1), 0, 0)
    for at, parse, sure in _SUREST:
        if (barred or parse is delimited) and np.float32(sure) + np.float32(1e-4) >= most[0] and (t := parse(own)):
            most, best = max((most, best), ((np.float32(t.confidence), len(t.rows) * len(t.rows[0]), at), t), key=lambda x: x[0])
    return best


#: The surest first, so that those that can't be surer than what was found needn't run.
_SUREST = sorted(((at, parse, sure) for at, (parse, sure) in enumerate(PARSERS)), key=lambda x: -x[2])


def cell(table: Table, row: int, column: int) -> str:
    """A cell by its place, empty where there is none."""
    return table.rows[row][column] if 0 <= row < len(table.rows) and 0 <= column < len(table.rows[row]) else ""
