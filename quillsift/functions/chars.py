"""Characters and lines as the sanitizing stages see them: Unicode White_Space, `\\n` lines, and the fixed tables of the stages."""

from __future__ import annotations

import re

# Unicode White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
WORD = re.compile(f"[^{WHITE}]+")

# Characters that are written plainly, and those that are removed.
PLAIN = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", " ": " "}
INVISIBLE = "​‌‍﻿"
EM_DASH, RECORDING_DOT, ESCAPE = "—", "⏺", "\x1b"

# UTF-8 text that was read as Latin-1, and what it was. Letters: C3 and the byte; signs: C2 and the byte;
# quotes: E2 80 and the byte.
MISREAD_LETTERS = "éüöäèêëïôûçàâîñÉÀÜÖÄ"
MISREAD_SIGNS = " «»°£¥©®"
MISREAD_QUOTES = "’“”"
MOJIBAKE = tuple((c.encode().decode("latin-1"), c) for c in MISREAD_LETTERS + MISREAD_SIGNS + MISREAD_QUOTES)

# First words that make a line a shell command.
SHELL_WORDS = tuple(
    "rm cp mv mkdir chmod ln touch cd ls open brew npm yarn pip pip3 cargo go make git docker curl wget ssh scp tar sudo python python3 "
    "node cat echo export source xcrun aws gcloud az kubectl terraform helm".split()
)

# Words that hint at a language, in the order in which later languages win ties.
KEYWORDS = {
    "python": ("def ", "import ", "print(", "class ", "elif ", "self.", "from "),
    "rust": ("fn ", "let mut ", "impl ", "use std::", "pub fn ", "match ", "&self", "println!", "::"),
    "javascript": ("function ", "const ", "=> ", "console.", "require(", "module.exports"),
    "swift": ("func ", "var ", "import Foundation", "guard let", "@objc", "NSObject"),
    "go": ("package ", "fmt.", "go ", ":= ", "interface{"),
    "java": ("public class", "System.out", "private ", "protected ", "@Override"),
}

# Query parameters that track, and their prefix.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "si", "ref_src", "_ga", "_gl")
TRACKING_PREFIX = "utm_"

# Applications whose text is left alone.
EXCLUDED_APPS = ("com.1password.1password", "com.agilebits.onepassword7", "com.lastpass.LastPass", "com.bitwarden.desktop", "org.keepassxc.keepassxc")

# Patterns of secrets by name, first match first. The texts they are about are only named here by shape.
SECRETS = (
    ("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("certificate", r"-----BEGIN CERTIFICATE-----"),
    ("base64", r"^[A-Za-z0-9+/]{40,}={0,2}$"),
    ("api_key", r"(sk|pk|rk|ak)[-_][a-zA-Z0-9]{20,}"),
    ("github", r"ghp_[a-zA-Z0-9]{36}"),
    ("slack", r"xox[bpsar]-[a-zA-Z0-9-]{10,}"),
    ("jwt", r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"),
    ("aws", r"AKIA[A-Z0-9]{16}"),
)

BOX = "┌┐└┘├┤┬┴┼─╭╮╰╯═╪║╞╡╟╢"
BARS = "│|"
FENCE = "`" * 3


def trim(s: str) -> str:
    return s.strip(WHITE)


def lines_of(s: str) -> list[str]:
    """Lines without their ends: `\\n` or `\\r\\n`; a last empty line doesn't count."""
    parts = s.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def words_of(s: str) -> list[str]:
    return WORD.findall(s)


def n_bytes(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def is_fence(line: str) -> bool:
    return trim(line).startswith(FENCE)


def outside_backticks(line: str, change) -> str:
    """line with change() applied to the parts outside backtick spans."""
    parts = line.split("`")
    parts[::2] = [change(p) for p in parts[::2]]
    return "`".join(parts)


def outside_fences(text: str, change) -> str:
    """text with change() applied to the lines outside code fences."""
    inside, out = False, []
    for line in text.split("\n"):
        if is_fence(line):
            inside = not inside
            out.append(line)
        else:
            out.append(line if inside else change(line))
    return "\n".join(out)
