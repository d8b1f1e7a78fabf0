"""URLs in text: tracking parameters, `www.` and, if asked, the scheme are dropped."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, unquote_plus

from ..functions.chars import TRACKING, TRACKING_PREFIX, WHITE, n_bytes, outside_backticks, outside_fences
from .base import SHELL, Context, Stage

_URL = re.compile(rf"""https?://[^{WHITE}<>"')\]]+""")
_PARTS = re.compile(r"(https?)://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?", re.S)
_PORTS = {"http": "80", "https": "443"}


def _host(raw: str) -> str | None:
    """A host in lower case, international names in their ASCII form; None if it can't be one."""
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    host = raw
    if not raw.isascii():
        try:
            host = raw.encode("idna").decode()
        except UnicodeError:
            return None
    host = host.lower()
    return None if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|]", host) else host


def _path(raw: str) -> str:
    """Dot segments resolved, unsafe characters percent-encoded."""
    segments: list[str] = []
    parts = raw.replace("\\", "/").split("/")[1:]
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        dots = re.sub("%2e", ".", p, flags=re.I)
        if dots == "..":
            segments = segments[:-1]
        elif dots != ".":
            segments.append(p)
            continue
        if last:
            segments.append("")
    return "/" + "/".join(quote(s, safe="!$%&'()*+,/:;=@~[]|^-._") for s in segments)


def _query_of(pairs: list[tuple[str, str]]) -> str:
    return quote("&".join(k if not v else f"{k}={v}" for k, v in pairs), safe="!$%&()*+,/:;=?@[]^_`{|}~\\-.")


def clean_url(url: str, *, strip_www: bool = True, strip_scheme: bool = False, deny: tuple[str, ...] = (), domains: dict[str, dict[str, list[str]]] | None = None, decode_pairs: bool = False) -> str | None:
    """The URL without what tracks; None if it doesn't parse. decode_pairs joins query pairs decoded, where an encoded & or =
    would change its meaning; without it pairs stay as they were written."""
    m = _PARTS.fullmatch(url)
    if m is None:
        return None
    scheme, authority, path, query, fragment = m.groups()
    login, _, place = authority.rpartition("@")
    at = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place)
    host = at and _host(at[1])
    if not host or (at[2] and int(at[2]) > 65535):
        return None
    if strip_www and host.startswith("www.") and len(host) > 4:
        host = host[4:]
    port = at[2].lstrip("0") or ("0" if at[2] else "") if at[2] else ""
    own = (domains or {}).get(host, {})

    def tracks(key: str) -> bool:
        if key in own.get("keep", ()):
            return False
        return key in own.get("deny", ()) or key in TRACKING or key in deny or key.startswith(TRACKING_PREFIX)

    pairs = []
    for part in (query or "?")[1:].split("&"):
        if part:
            k, _, v = part.partition("=")
            if not tracks(unquote_plus(k)):
                pairs.append((unquote_plus(k), unquote_plus(v)) if decode_pairs else (k, v))
    out = "" if strip_scheme else f"{scheme}://"
    out += (f"{login}@" if login else "") + host + (f":{port}" if port and port != _PORTS[scheme] else "")
    out += _path(path) if path else "/"
    out += f"?{_query_of(pairs)}" if pairs else ""
    out += quote(fragment, safe="!#$%&'()*+,/:;=?@[]^_{|}~\\-.") if fragment else ""
    return out[:-1] if out.endswith("/") and not url.endswith("/") else out


def link_stage(**how) -> Stage:
    def run(text: str, ctx: Context) -> str:
        if ctx.content_type == SHELL:
            return text
        gone = 0

        def cleaned(m: re.Match) -> str:
            nonlocal gone
            new = clean_url(m[0], **how)
            if new is None:
                return m[0]
            gone += max(0, n_bytes(m[0]) - n_bytes(new))
            return new

        out = outside_fences(text, lambda line: outside_backticks(line, lambda part: _URL.sub(cleaned, part)))
        if gone:
            ctx.fired("url_cleaning", f"cleaned {gone} bytes from URLs", gone)
        return out

    return run
