"""HTML as a rich source: code-styled runs become backtick spans, and the better of the rich and the plain text is chosen."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from ..functions.chars import FENCE, outside_backticks, outside_fences, trim
from .codespans import is_older_code_token, wrap_token

_CODE_TAGS = {"code", "tt", "kbd", "samp"}
_BREAKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote"}
_MONO = re.compile(r"font-family[^;]*(mono|courier|menlo|consolas)", re.I)
_COLOR = re.compile(r"(?<![-\w])color\s*:\s*(?:#([0-9a-f]{8}|[0-9a-f]{6}|[0-9a-f]{3,4})\b|rgba?\(([^)]*)\)|([a-z]+))", re.I)
#: Chroma and opacity from which a colour marks code.
LEAST_CHROMA, LEAST_ALPHA = 0.08, 0.95
#: The sixteen basic colours of style sheets, and a few that editors use.
NAMED = {
    "black": 0x000000, "silver": 0xC0C0C0, "gray": 0x808080, "grey": 0x808080, "white": 0xFFFFFF, "maroon": 0x800000, "red": 0xFF0000, "purple": 0x800080, "fuchsia": 0xFF00FF, "magenta": 0xFF00FF,
    "green": 0x008000, "lime": 0x00FF00, "olive": 0x808000, "yellow": 0xFFFF00, "navy": 0x000080, "blue": 0x0000FF, "teal": 0x008080, "aqua": 0x00FFFF, "cyan": 0x00FFFF, "orange": 0xFFA500,
}


def _number(part: str, whole: float) -> float:
    part = part.strip()
    return float(part[:-1]) / 100 if part.endswith("%") else float(part) / whole


def colour_of(style: str) -> tuple[float, float, float, float] | None:
    """Red, green, blue and opacity (0 to 1) of a style's colour: hexadecimal, rgb(), rgba() or a name; None without one."""
    m = _COLOR.search(style)
    if not m:
        return None
    if m[1]:
        digits = m[1] if len(m[1]) > 4 else "".join(c * 2 for c in m[1])
        parts = [int(digits[i : i + 2], 16) / 255 for i in range(0, len(digits), 2)]
        return (*parts[:3], parts[3] if len(parts) == 4 else 1.0)
    if m[2] is not None:
        try:
            parts = re.split(r"[\s,/]+", m[2].strip())
            return (*(_number(x, 255) for x in parts[:3]), _number(parts[3], 1) if len(parts) > 3 else 1.0) if len(parts) >= 3 else None
        except ValueError:
            return None
    rgb = NAMED.get(m[3].lower())
    return None if rgb is None else (*((rgb >> shift & 255) / 255 for shift in (16, 8, 0)), 1.0)


def is_coloured(style: str) -> bool:
    """A colour that is nearly opaque and no grey."""
    c = colour_of(style)
    return c is not None and c[3] >= LEAST_ALPHA and max(c[:3]) - min(c[:3]) >= LEAST_CHROMA


class _Runs(HTMLParser):
    """(text, monospaced, coloured) runs of a page, with line breaks at blocks; scripts and styles are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.runs: list[tuple[str, bool, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        style = dict(attrs).get("style") or ""
        if tag in ("script", "style", "title"):
            self.hidden += 1
        if tag in _BREAKS:
            self.runs.append(("\n", False, False))
        if tag == "li":
            self.runs.append(("- ", False, False))
        if tag == "pre":
            self.runs.append((f"\n{FENCE}\n", False, False))
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self.open.append((tag, tag in _CODE_TAGS or bool(_MONO.search(style)), is_coloured(style)))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        if tag in ("script", "style", "title"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "pre":
            self.runs.append((f"\n{FENCE}\n", False, False))
        del self.open[at:]
        if tag in _BREAKS:
            self.runs.append(("\n", False, False))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            fenced = any(t == "pre" for t, _, _ in self.open)
            text = data if fenced else re.sub(r"\s+", " ", data)
            self.runs.append((text, not fenced and any(m for _, m, _ in self.open), any(c for _, _, c in self.open)))


def _span(text: str) -> str:
    own = text.strip()
    return text.replace(own, f"`{own}`", 1) if own and "`" not in own else text


def rich_text(html: str | None) -> str | None:
    """The text of a page. If all of it is monospaced, coloured runs are spans; else code-styled runs are, token by token if they
    have several words."""
    if html is None:
        return None
    parser = _Runs()
    parser.feed(html)
    parser.close()
    filled = [r for r in parser.runs if r[0].strip()]
    all_mono = bool(filled) and all(m for _, m, _ in filled)
    out = ""
    for text, mono, coloured in parser.runs:
        if all_mono:
            out += _span(text) if coloured else text
        elif mono:
            out += _span(text) if len(text.split()) == 1 else re.sub(r"\S+", lambda m: wrap_token(m[0]), text)
        else:
            out += text
    return trim(re.sub(r"[ \t]*\n\s*\n[ \t]*|[ \t]*\n[ \t]*", "\n", out))


# What counts as a list item or a fence for structure_score.
_ITEM, _FENCE = re.compile(r"(?m)^\s*(?:[-*]\s+|\d+[.)\]]\s+)"), re.compile(r"(?m)^\s*" + FENCE)


def structure_score(text: str) -> int:
    return 3 * len(_ITEM.findall(text)) + 5 * len(_FENCE.findall(text)) + min(text.count("`") // 2, 30)


def wrapped_tokens(text: str) -> str:
    """The text with code-like tokens in backticks by the older rules, outside fences and spans, for sources without styles."""
    return outside_fences(text, lambda line: outside_backticks(line, lambda part: re.sub(r"\S+", lambda m: wrap_token(m[0], is_older_code_token), part)))


def better_text(rich: str | None, plain: str | None) -> str | None:
    """The rich text, unless it has no structure where the plain one has, or lost over a quarter of the length. Alone, a rich text gets the
    backticks of wrapped_tokens(); None if there is neither."""
    if not rich:
        return plain or None
    if plain is None:
        return wrapped_tokens(rich) or rich
    if not plain:
        return rich
    if (structure_score(rich) == 0 and structure_score(plain) > 0) or len(rich) * 4 < len(plain) * 3:
        return plain
    return rich
