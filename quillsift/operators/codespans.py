"""Backticks around what looks like code: flags, paths, file names, identifiers, calls, and whole commands."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.chars import WORD, n_bytes, outside_backticks, outside_fences, trim
from .base import SHELL, Context
from .layout import is_shell_command

# Punctuation that may stand before and after a token.
OPENING, CLOSING = "([{\"'“‘", ".,;:!?)]}\"'”’"
# Tokens that are code by their shape, as one pattern each.
SHAPES = {
    "file": r"[A-Za-z0-9._-]+\.[A-Za-z0-9]{1,8}(:\d+)?",
    "camel": r"(?=.*[a-z])[A-Za-z]+[A-Z][A-Za-z0-9]*",
    "screaming": r"[A-Z][A-Z0-9_]{3,}",
    "host_port": r"[a-zA-Z0-9.-]+:\d{1,5}",
    "dotted": r"[a-zA-Z][a-zA-Z0-9]+(\.[a-zA-Z][a-zA-Z0-9]+)+",
    "variable": r"\$[^ ]+",
    "reference": r".*#.*>",
}
_SHAPE = re.compile("|".join(f"(?:{s})" for s in SHAPES.values()), re.S)
_CALL = re.compile(rf"([A-Za-z][A-Za-z0-9]*\([^)]*\))([{re.escape(CLOSING)}]*)")


# The shapes of the older rules, which knew neither calls nor dotted names and took shorter capitals.
OLDER_SHAPES = {"file": SHAPES["file"], "camel": r"[A-Za-z]+[A-Z][A-Za-z0-9]*", "screaming": r"[A-Z][A-Z0-9_]{2,}"}
_OLDER = re.compile("|".join(f"(?:{s})" for s in OLDER_SHAPES.values()))


def is_older_code_token(token: str) -> bool:
    """The older rules for one token, as a variant."""
    if not 2 <= len(token) <= 100 or "`" in token or token.startswith(("http://", "https://")):
        return False
    path = "/" in token and (token.startswith(("/", "./", "../")) or any(c in token for c in ".-:"))
    return token.startswith("--") or "_" in token or path or _OLDER.fullmatch(token) is not None


def is_code_token(token: str) -> bool:
    if not 2 <= n_bytes(token) <= 100 or "`" in token or token.startswith(("http://", "https://")):
        return False
    if re.match(r"--[A-Za-z0-9]", token) or "_" in token:
        return True
    if "/" in token and (token.startswith(("/", "./", "../")) or any(c in token for c in ".-:")):
        return True
    return _SHAPE.fullmatch(token) is not None


def wrap_token(token: str, is_code: Callable[[str], bool] = is_code_token) -> str:
    """The token with backticks around what is code of it; the older rules know no calls."""
    rest = token.lstrip(OPENING)
    before = token[: len(token) - len(rest)]
    if is_code is is_code_token and (call := _CALL.fullmatch(rest)):
        return f"{before}`{call[1]}`{call[2]}"
    core = rest.rstrip(CLOSING)
    return f"{before}`{core}`{rest[len(core) :]}" if is_code(core) else token


def _is_wrapped(own: str) -> bool:
    return own.startswith("`") and own.endswith("`")


def codespan_stage(text: str, ctx: Context) -> str:
    added = 0

    def whole(line: str) -> str:
        own = trim(line)
        if not own or own.startswith("#") or _is_wrapped(own):
            return line
        nonlocal added
        added += 2
        return f"`{own}`"

    def tokens(line: str) -> str:
        nonlocal added
        own = trim(line)
        if own and not _is_wrapped(own) and is_shell_command(own):
            added += 2
            return f"`{own}`"
        out = outside_backticks(line, lambda part: WORD.sub(lambda m: wrap_token(m[0]), part))
        added += n_bytes(out) - n_bytes(line)
        return out

    out = "\n".join(map(whole, text.split("\n"))) if ctx.content_type == SHELL else outside_fences(text, tokens)
    if added > 0:
        ctx.fired("auto_wrapper", f"wrapped {added} bytes of code-like tokens", added)
    return out
