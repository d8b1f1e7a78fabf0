"""Stages and predicates as column expressions: built-in functions only, so that they stay in code generation and Catalyst can
push and prune around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import BARS, EM_DASH, INVISIBLE, KEYWORDS, MOJIBAKE, PLAIN, RECORDING_DOT, SECRETS, SHELL_WORDS, TRACKING, TRACKING_PREFIX, WHITE

#: White_Space as Java and RE2 character classes read it.
CLASS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Without the newline.
IN_LINE = r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# What begins a list item.
LIST_ITEM = rf"^(- |\* |[•◦▪][{CLASS}]|\p{{Nd}}+[.)\]] )"
# A token that autowrapping puts in backticks, but for its length. Camel case takes two patterns, as RE2 has no look-ahead.
CODE_TOKEN = "|".join(
    [
        r"^--[A-Za-z0-9]",
        "_",
        r"^\.{0,2}/",
        r"/.*[.:-]",
        r"[.:-].*/",
        r"^[A-Za-z0-9._-]+\.[A-Za-z0-9]{1,8}(:\p{Nd}+)?$",
        r"^[A-Za-z]*[a-z][A-Za-z]*[A-Z][A-Za-z0-9]*$",
        r"^[A-Za-z]+[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*$",
        r"^[A-Z][A-Z0-9_]{3,}$",
        r"^[a-zA-Z0-9.-]+:\p{Nd}{1,5}$",
        r"^\$.",
        r"#.*>$",
        r"^[a-zA-Z][a-zA-Z0-9]+(\.[a-zA-Z][a-zA-Z0-9]+)+$",
    ]
)


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE))


def trimmed_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


# ---- guards


def is_oversize(text: Column, most: int) -> Column:
    return F.octet_length(text) > most


def secret_name(text: Column) -> Column:
    """The first pattern of SECRETS that the trimmed text matches, else null."""
    own = trimmed(text)
    return F.coalesce(*[F.when(own.rlike(_anchored(p)), F.lit(name)) for name, p in SECRETS])


def _anchored(p: str) -> str:
    return p.removesuffix("$") + r"\z" if p.endswith("$") else p


def has_secret(text: Column) -> Column:
    """secret_name() without the name: one pattern instead of one after the other."""
    return F.coalesce(trimmed(text).rlike("|".join(f"(?:{_anchored(p)})" for _, p in SECRETS)), F.lit(False))


def within_expansion(out: Column, text: Column, most: float = 2.0) -> Column:
    """out, or text if out is more than so many times its bytes."""
    return F.when(F.octet_length(out) > most * F.octet_length(text), text).otherwise(out)


def is_excluded(app: Column, apps: tuple[str, ...]) -> Column:
    return app.isin(list(apps))


# ---- unicode and artifacts


def plain_characters(text: Column, em_dash: str = "--") -> Column:
    """Straight quotes, hyphens and spaces, nothing invisible; em_dash stands for an em dash, empty keeps it."""
    out = F.translate(text, "".join(PLAIN) + INVISIBLE, "".join(PLAIN.values()))
    return F.replace(out, F.lit(EM_DASH), F.lit(em_dash)) if em_dash else out


def repaired_mojibake(text: Column) -> Column:
    def repair(p: Column) -> Column:
        hits = sum((F.contains(p, F.lit(bad)).cast("int") for bad, _ in MOJIBAKE), F.lit(0))
        fixed = p
        for bad, good in MOJIBAKE:
            fixed = F.replace(fixed, F.lit(bad), F.lit(good))
        return F.when(hits >= 3, fixed).otherwise(p)

    return F.array_join(F.transform(F.split(text, "\n\n", -1), repair), "\n\n")


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1B\[[0-9;]*[A-Za-z]", "")


def without_recording_dots(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?md)^([{IN_LINE}]*){RECORDING_DOT}+[{IN_LINE}]*", "$1")


def without_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def without_artifacts(text: Column) -> Column:
    return without_invisible(without_recording_dots(without_ansi(text)))


def bytes_changed(out: Column, text: Column) -> Column:
    return F.abs(F.octet_length(out) - F.octet_length(text))


# ---- lines


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def filled_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: x != "")


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_ITEM)


def ends_sentence(line: Column) -> Column:
    return trimmed(line).rlike(r"[.?!]\z")


def is_indented(line: Column) -> Column:
    return line.rlike(r"^[ \t]")


def collapsed_padding(line: Column) -> Column:
    """One line without trailing blanks, with gaps of three blanks or more made one, and without an indent beyond 20."""
    own = trimmed_right(line)
    lead = F.regexp_extract(own, r"^[ \t]*", 0)
    body = F.substring(own, F.length(lead) + 1, F.length(own))
    return F.when(body == "", own).otherwise(F.concat(F.when(F.length(lead) > 20, "").otherwise(lead), F.regexp_replace(body, " {3,}", " ")))


def is_shell_command(line: Column) -> Column:
    own = trimmed(line)
    own = F.when(own.rlike(r"^`(?s:.)+`\z") & (F.octet_length(own) > 2), F.substring(own, 2, F.length(own) - 2)).otherwise(own)
    words = F.filter(F.split(own, rf"[{CLASS}]+", -1), lambda w: w != "")
    first = F.get(words, F.lit(0))
    command = F.when(first == "sudo", F.coalesce(F.get(words, F.lit(1)), F.lit(""))).otherwise(first)
    argument = F.exists(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: w.rlike(r"/|^[~$]|^-."))
    return F.coalesce(F.startswith(command, F.lit("./")) | (command.isin(list(SHELL_WORDS)) & argument), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(0)


def share_of_lines(text: Column, test) -> Column:
    """Per cent (rounded down) of the filled lines that test() holds for."""
    own = filled_lines(text)
    return percent(F.size(F.filter(own, test)), F.size(own))


def looks_like_code(text: Column) -> Column:
    return (F.size(lines(text)) > 3) & (F.startswith(text, F.lit("#!")) | ((share_of_lines(text, is_indented) >= 40) & (share_of_lines(text, ends_sentence) < 30)))


def looks_like_list(text: Column) -> Column:
    return (F.size(filled_lines(text)) >= 2) & (share_of_lines(text, lambda x: is_list_item(trimmed(x))) >= 60)


def keyword_score(text: Column, language: str) -> Column:
    """How often the language's keywords occur."""
    return sum((((F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k)).cast("int") for k in KEYWORDS[language]), F.lit(0))


def language(text: Column) -> Column:
    """The language of most keywords (the later of equals), with two at least; else null."""
    best = F.greatest(*[F.struct(keyword_score(text, x).alias("n"), F.lit(i).alias("i"), F.lit(x).alias("name")) for i, x in enumerate(KEYWORDS)])
    return F.when(best["n"] >= 2, best["name"])


#: Of the characters here every code token has one, or a capital after its first letter, or capitals only.
_CODE_SIGN = r"[-_./:#$]|.[A-Z]"


def is_code_token(token: Column) -> Column:
    """Cheap conditions stand first: most words have neither a sign nor a capital inside."""
    return (F.octet_length(token).between(2, 100)) & token.rlike(_CODE_SIGN) & ~F.contains(token, F.lit("`")) & ~token.rlike("^https?://") & token.rlike(CODE_TOKEN)


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{CLASS}]+", -1), lambda w: w != "")


def code_token_count(text: Column) -> Column:
    return F.size(F.filter(words(text), is_code_token))


def width_cluster(text: Column, short: int = 40, spread: int = 4) -> Column:
    """struct<cluster, long_lines, width>: the size of the largest cluster of lengths of long lines (those within `spread` above one), how many
    lines are long, and the upper end of that cluster, 0 under three lines. Of equal clusters a later one counts if it begins beyond
    the end of the one before. Null without long lines."""

    def widest(sizes: Column) -> Column:
        n, start = F.size(sizes), F.lit(0)
        # a window of sorted sizes that grows by each one that fits, and moves on otherwise: its final size is the largest
        most = F.aggregate(F.sequence(start, n - 1), start, lambda k, j: k + (F.get(sizes, j) - F.get(sizes, j - k) <= spread).cast("int"))

        def last(k: Column) -> Column:
            # no cluster is larger, so those of this size are the places whose k-th size still fits
            ends = lambda w, i: F.when((F.get(sizes, i) > w) & (F.get(sizes, i + k - 1) - F.get(sizes, i) <= spread), F.get(sizes, i + k - 1)).otherwise(w)
            return F.struct(k.alias("cluster"), n.alias("long_lines"), F.when(k >= 3, F.aggregate(F.sequence(start, n - k), start, ends)).otherwise(0).alias("width"))

        return once(most, last)

    long_lines = F.filter(lines(text), lambda x: F.length(x) > short)
    sizes = F.array_sort(F.filter(F.transform(long_lines, lambda x: F.length(trimmed_right(x))), lambda n: n > short))
    return once(sizes, lambda x: F.when(F.size(x) > 0, widest(x)))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once: an expression that stands in a lambda is computed for each element otherwise."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def wrapped_commands(text: Column) -> Column:
    """Each line of a block of commands in backticks, but for blank lines, comments and what is wrapped."""

    def wrap(line: Column) -> Column:
        own = trimmed(line)
        return F.when((own == "") | own.rlike("^#") | (F.startswith(own, F.lit("`")) & F.endswith(own, F.lit("`"))), line).otherwise(F.concat(F.lit("`"), own, F.lit("`")))

    return F.array_join(F.transform(lines(text), wrap), "\n")


# ---- URLs (ASCII, without credentials, ports to drop or dot segments)


def clean_url(url: Column, strip_www: bool = True, strip_scheme: bool = False, deny: tuple[str, ...] = TRACKING) -> Column:
    """The URL without tracking parameters."""
    scheme = F.lower(F.regexp_extract(url, r"^(https?)://", 1))
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))
    if strip_www:
        host = F.regexp_replace(host, r"^www\.(?=.)", "")
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    pairs = F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~tracks(F.substring_index(p, "=", 1), deny))
    pairs = F.transform(pairs, lambda p: F.regexp_replace(p, "=$", ""))
    out = F.concat(*([] if strip_scheme else [scheme, F.lit("://")]), host, F.when(path == "", "/").otherwise(path), F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""), fragment)
    out = F.when(F.endswith(out, F.lit("/")) & ~F.endswith(url, F.lit("/")), F.substring(out, 1, F.length(out) - 1)).otherwise(out)
    return F.when(scheme == "", url).otherwise(out)


def tracks(key: Column, deny: tuple[str, ...] = TRACKING) -> Column:
    return key.isin(list(deny)) | F.startswith(key, F.lit(TRACKING_PREFIX))


# ---- tables and summaries


def cell(rows: Column, row: int, column: int) -> Column:
    return F.coalesce(F.get(F.get(rows, F.lit(row)), F.lit(column)), F.lit(""))


def row_matches(row: Column, query: str) -> Column:
    """Any cell holds the query, whatever the case; an empty query fits all."""
    return F.exists(row, lambda c: F.contains(F.lower(c), F.lit(query.strip(WHITE).lower())))


def bar_count(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, BARS, ""))


def gated(table: Column, enabled: bool, least: float) -> Column:
    """A table below the confidence is cleared, with a warning."""
    low = table["detected"] & (table["confidence"] < F.lit(least).cast("float"))
    note = F.lit("table picker disabled by configuration") if not enabled else F.format_string(f"table confidence %.2f below threshold {least:.2f}", table["confidence"].cast("double"))
    off = F.lit(True) if not enabled else low
    return F.struct(
        (table["detected"] & ~off).alias("detected"), F.when(~off, table["format"]).alias("format"), table["confidence"].alias("confidence"),
        F.when(off, F.array().cast("array<array<string>>")).otherwise(table["rows"]).alias("rows"), F.when(off, F.array_append(table["warnings"], note)).otherwise(table["warnings"]).alias("warnings"),
    )


def summary(stages: Column, labels: dict[str, str]) -> Column:
    """One line about the stages that fired, two labels at most."""
    named = F.transform(F.array_distinct(stages), lambda s: F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[s], F.lit("Applied cleanup")))
    more = F.when(F.size(named) > 2, F.concat(F.lit(" +"), (F.size(named) - 2).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(named) == 0, "No changes needed").otherwise(F.concat(F.array_join(F.slice(named, 1, 2), " · "), more))


def preview(text: Column) -> Column:
    flat = F.translate(text, "\n", " ")
    return F.when(F.length(flat) > 80, F.concat(F.substring(flat, 1, 77), F.lit("..."))).otherwise(flat)
