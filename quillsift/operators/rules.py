"""User rules: named patterns with replacements, in order, in the dialect of linear-time engines.

Patterns that only a backtracking engine has (look-around, back references, atomic and possessive groups, recursion), and repetitions without
end inside repetitions without end, are refused when rules are compiled, which is the same on every machine. `$` is the end of the
text, an empty match right after a match is none, and `\\z`, `\\p{L}` and `[[:alpha:]]` are known. What still runs longer than MOST_SECONDS on one text
is given up for that text, and the context says so.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from ..functions.chars import n_bytes
from .base import Context, Stage

MOST_RULES = 50
#: Seconds that one rule may take on one text.
MOST_SECONDS = 2.0
_REFUSED = re.compile(r"\(\?(?:[=!>|R&(]|<[=!]|P[=>]|[0-9+-]+\))|\(\*|(?<!\\)(?:\\\\)*\\(?:[1-9]|[gkKGL]|N\{)")
_REFERENCE = re.compile(r"\$(?:\$|\{([^}]*)\}|([A-Za-z0-9_]+))")
_REPEAT = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\}|\{,\d+\})(\+?)\??")


class RuleError(ValueError):
    """A rule that can't be used, by its name."""


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    replacement: str


def _endless(repeat: str) -> bool:
    return repeat[0] in "*+" or ",}" in repeat


def _translated(pattern: str) -> str:
    """The pattern as the module regex reads it; raises ValueError at endless repetition of what repeats endlessly."""
    multiline = re.match(r"\(\?[a-z]*m[a-z]*\)", pattern) is not None
    if not multiline and re.search(r"\(\?[a-z]*m", pattern):
        raise ValueError("multi-line mode is known for whole patterns only")
    out, i, klass = "", 0, 0
    groups = [False]  # whether each open group repeats something without end
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if m := re.match(r"\\[xu]\{([0-9A-Fa-f]+)\}", pattern[i:]):
                out += regex.escape(chr(int(m[1], 16)))
                i += m.end()
            elif re.match(r"\\[pP]\{", pattern[i:]):
                end = pattern.index("}", i) + 1
                out += pattern[i:end]
                i = end
            else:
                out += r"\Z" if two == r"\z" and not klass else two
                i += 2
            continue
        if klass:
            klass += (c == "[") - (c == "]")
        elif c == "[":
            klass = 1
            if m := re.match(r"\[\^?\]", pattern[i:]):  # a bracket that stands first is itself
                out += m[0][:-1] + r"\]"
                i += m.end()
                continue
        elif c == "$" and not multiline:
            out += r"\Z"
            i += 1
            continue
        elif c == "(":
            groups.append(False)
        elif c == ")":
            last = groups.pop() if len(groups) > 1 else False
            groups[-1] |= last
            out += c
            i += 1
            if m := _REPEAT.match(pattern, i):
                if last and _endless(m[0]):
                    raise ValueError("repetition without end inside repetition without end")
            continue
        elif m := _REPEAT.match(pattern, i):
            if m[1]:
                raise ValueError("possessive repetition is not supported")
            groups[-1] |= _endless(m[0])
            out += m[0]
            i = m.end()
            continue
        out += c
        i += 1
    return out


def compiled(rule: Rule) -> regex.Pattern:
    if _REFUSED.search(rule.pattern):
        raise RuleError(f"Invalid regex in rule '{rule.name}': look-around, back references, recursion, atomic and possessive groups are not supported")
    try:
        return regex.compile(_translated(rule.pattern), regex.V1)
    except (regex.error, ValueError) as e:
        raise RuleError(f"Invalid regex in rule '{rule.name}': {e}") from e


def expanded(replacement: str, m: regex.Match) -> str:
    """`$1`, `${1}`, `$name`, `${name}` are groups (empty if there is none), `$$` a dollar; a name runs as far as it can."""

    def group(r: re.Match) -> str:
        if r[0] == "$$":
            return "$"
        name = r[1] if r[1] is not None else r[2]
        try:
            return m[int(name) if name.isdigit() else name] or ""
        except (IndexError, KeyError):
            return ""

    return _REFERENCE.sub(group, replacement)


def java_replacement(replacement: str, pattern: regex.Pattern) -> str:
    """The replacement as Spark's regexp_replace reads it."""

    def group(r: re.Match) -> str:
        if r[0] == "$$":
            return r"\$"
        name = r[1] if r[1] is not None else r[2]
        if name.isdigit():
            return f"${int(name)}" if int(name) <= pattern.groups else ""
        return f"${{{name}}}" if name in pattern.groupindex else ""

    out, at = "", 0
    for r in _REFERENCE.finditer(replacement):
        out += re.sub(r"([\\$])", r"\\\1", replacement[at : r.start()]) + group(r)
        at = r.end()
    return out + re.sub(r"([\\$])", r"\\\1", replacement[at:])


def replaced(pattern: regex.Pattern, replacement: str, text: str, seconds: float = MOST_SECONDS) -> tuple[str, int]:
    """The text with all matches replaced, and their number; TimeoutError if that takes longer."""
    out, at, n = [], 0, 0
    for m in pattern.finditer(text, timeout=seconds):
        if m.end() == m.start() == at and n:  # right after a match
            continue
        out += [text[at : m.start()], expanded(replacement, m)]
        at, n = m.end(), n + 1
    return "".join([*out, text[at:]]), n


def rule_stage(rules: list[Rule]) -> Stage:
    own = [(r, compiled(r)) for r in rules[:MOST_RULES]]

    def run(text: str, ctx: Context) -> str:
        for rule, pattern in own:
            try:
                out, n = replaced(pattern, rule.replacement, text)
            except TimeoutError:
                ctx.fired("user_rules", f"rule '{rule.name}' timed out after {MOST_SECONDS:g}s", 0)
                continue
            if n:  # it fires if it matches, even if the text stays the same
                ctx.fired("user_rules", f"rule '{rule.name}' fired", abs(n_bytes(out) - n_bytes(text)))
                text = out
        return text

    return run
