"""Queries over texts that are made from whole documents by a projection, so that SQL can state what a stage must make of them.

The letters of a document, cut into pieces, are laid out as paragraphs, lists, commands, fences, boxes, tables and code. A projection is one
expression for Spark (`s`) and one for DuckDB (`d`); what is expected is DuckDB alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import FENCE
from ..operators import cleaner
from ..operators.rules import Rule
from ..sources import text
from ..sources.config import Config, Settings
from .queries import OPEN, RULES, docs, query

NL = "chr(10)"


class S:
    """Spark's spelling."""

    letters = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' '))"
    run = "regexp_replace(lower(coalesce(text, '')), '[^a-z]+', '')"
    join = staticmethod(lambda x, by=NL: f"array_join({x}, {by})")
    each = staticmethod(lambda x, e: f"transform({x}, (x, i) -> {e})")
    cut = staticmethod(lambda x, n: f"if({x} = '', array(''), regexp_extract_all({x}, '.{{1,{n}}}', 0))")
    add = staticmethod(lambda x, *more: f"concat({x}, array({', '.join(more)}))")
    keep = staticmethod(lambda x, e: f"filter({x}, x -> {e})")


class D:
    """DuckDB's spelling; i counts from 0 in both."""

    letters = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'))"
    run = "regexp_replace(lower(coalesce(text, '')), '[^a-z]+', '', 'g')"
    join = staticmethod(lambda x, by=NL: f"array_to_string({x}, {by})")
    each = staticmethod(lambda x, e: f"list_transform({x}, lambda x, j: {e.replace('i %', '(j - 1) %').replace('<i>', '(j - 1)')})")
    cut = staticmethod(lambda x, n: f"CASE WHEN {x} = '' THEN [''] ELSE regexp_extract_all({x}, '.{{1,{n}}}') END")
    add = staticmethod(lambda x, *more: f"list_concat({x}, [{', '.join(more)}])")
    keep = staticmethod(lambda x, e: f"list_filter({x}, lambda x: {e})")


def made(make) -> str:
    """The projection for Spark."""
    return make(S).replace("<i>", "i")


def expected(pieces: str, sql: str) -> str:
    """sql over p (doc_id, p: pieces, n: how many)."""
    return f"WITH p AS MATERIALIZED (SELECT doc_id, lang, text, p, len(p) AS n FROM (SELECT doc_id, lang, text, {pieces} AS p FROM documents)) {sql}"


def grouped(size: int, block: str, by: str, p: str = "p") -> str:
    """block over g, a list of `size` pieces each, joined."""
    return f"array_to_string(list_transform(range(0, ((len({p}) + {size} - 1) // {size})::BIGINT), lambda k: list_transform([{p}[(k * {size} + 1)::INT:(k * {size} + {size})::INT]], lambda g: {block})[1]), {by})"


def said(x: str) -> str:
    """A list of pieces as running text."""
    return f"array_to_string(list_filter(list_transform({x}, lambda y: trim(y)), lambda y: y <> ''), ' ')"


def cleaned(spark: SparkSession, sf_dir: str, make, names: list[str] | None, config: Config = OPEN) -> DataFrame:
    return cleaner.clean(docs(spark, sf_dir, made(make)).select("doc_id", "text"), config=config, names=names)


# ---- layout

_PIECES = lambda q: q.cut(q.letters, 30)
_FENCED = f"'{FENCE}py', {NL}, x, {NL}, '{FENCE}'"


@query(expected(_PIECES(D), f"SELECT doc_id, {grouped(6, said('g'), f'{NL} || {NL}')} AS cleaned FROM p"))
def layout_paragraphs(spark, sf_dir):
    """Hard-wrapped paragraphs of six lines are unwrapped; short lines say nothing about a width."""
    make = lambda q: q.join(q.each(_PIECES(q), f"concat(x, CASE WHEN i % 6 = 5 THEN {NL} ELSE '' END)"))
    return cleaned(spark, sf_dir, make, ["whitespace_cleanup"]).select("doc_id", "cleaned")


@query(expected(_PIECES(D), f"SELECT doc_id, {grouped(3, f'''rtrim(concat('- ', {said('g')}))''', NL)} AS cleaned FROM p"))
def layout_lists(spark, sf_dir):
    """Bullets get one spelling and lose their common indent; continuation lines join their item."""
    make = lambda q: q.join(q.each(_PIECES(q), "concat(CASE WHEN i % 3 = 0 THEN '  •  ' ELSE '    ' END, x)"))
    return cleaned(spark, sf_dir, make, ["whitespace_cleanup"]).select("doc_id", "cleaned")


@query(expected(_PIECES(D), f"SELECT doc_id, {grouped(4, f'''concat({said('g[1:3]')}, CASE WHEN len(g) = 4 THEN concat({NL}, 'rm -rf /tmp/', replace(substr(g[4], 1, 20), ' ', '_')) ELSE '' END)''', NL)} AS cleaned FROM p"))
def layout_commands(spark, sf_dir):
    """Commands among prose keep lines of their own."""
    make = lambda q: q.join(q.each(_PIECES(q), "CASE WHEN i % 4 = 3 THEN concat('  rm -rf /tmp/', replace(substr(x, 1, 20), ' ', '_'), '  ') ELSE x END"))
    return cleaned(spark, sf_dir, make, ["whitespace_cleanup"]).select("doc_id", "cleaned")


_CODE = f"concat('{FENCE}py', {NL}, g[3], {NL}, '{FENCE}')"


@query(expected(_PIECES(D), f"SELECT doc_id, {grouped(3, f'''concat({said('g[1:2]')}, CASE WHEN len(g) = 3 THEN concat({NL}, {NL}, {_CODE}) ELSE '' END)''', f'{NL} || {NL}')} AS cleaned FROM p"))
def layout_fences(spark, sf_dir):
    """What stands in a fence stays as it is, blanks and all, and the fence is a block of its own."""
    make = lambda q: q.join(q.each(_PIECES(q), f"CASE WHEN i % 3 = 2 THEN concat({_FENCED}) ELSE x END"))
    return cleaned(spark, sf_dir, make, ["whitespace_cleanup"]).select("doc_id", "cleaned")


_LINES = lambda q: q.cut(q.run, 134)  # noqa: E731  of 60, 17 and 57 letters, the last after two letters and a blank
_PARTS = "[substr(x, 1, 60), substr(x, 61, 17), CASE WHEN length(x) > 77 THEN 'ab ' || substr(x, 78) ELSE '' END]"
_FLAT = f"list_filter(flatten(list_transform(p, lambda x: {_PARTS})), lambda y: y <> '')"
_KEPT = "array_to_string(list_transform(l, lambda y, j: concat(y, CASE WHEN j = len(l) THEN '' WHEN length(y) = 17 AND starts_with(l[j + 1], 'ab ') AND wide THEN chr(10) ELSE ' ' END)), '')"


@query(expected(_LINES(D), f", l AS (SELECT doc_id, l, len(list_filter(l, lambda y: length(y) >= 56)) >= 3 AS wide FROM (SELECT doc_id, {_FLAT} AS l FROM p)) SELECT doc_id, {_KEPT} AS cleaned FROM l"))
def layout_width(spark, sf_dir):
    """Where the terminal was 60 wide, a break after a short line is meant if the next word would have fitted; without three lines of a width none is."""
    make = lambda q: q.join(q.each(_LINES(q), f"concat(substr(x, 1, 60), CASE WHEN length(x) > 60 THEN concat({NL}, substr(x, 61, 17)) ELSE '' END, CASE WHEN length(x) > 77 THEN concat({NL}, 'ab ', substr(x, 78)) ELSE '' END)"))
    return cleaned(spark, sf_dir, make, ["whitespace_cleanup"]).select("doc_id", "cleaned")


_SHELL = lambda q: q.join(q.each(_PIECES(q), "concat('  curl ', CASE WHEN i % 2 = 0 THEN concat(chr(92), chr(10), '   ') ELSE '' END, '-s /', replace(x, ' ', '_'))"))


@query(expected(_PIECES(D), f"SELECT doc_id, array_to_string(list_transform(p, lambda x: concat('curl -s /', replace(x, ' ', '_'))), {NL}) AS cleaned, array_to_string(list_transform(p, lambda x: concat('`curl -s /', replace(x, ' ', '_'), '`')), {NL}) AS wrapped, 'ShellBlock' AS content_type FROM p"))
def shell_blocks(spark, sf_dir):
    """Text of commands alone: continued lines are joined, all keep their lines, and each is wrapped whole."""
    alone = cleaned(spark, sf_dir, _SHELL, ["whitespace_cleanup"])
    both = cleaner.clean(alone, config=OPEN, names=["whitespace_cleanup", "auto_wrapper"], out_col="wrapped", ctx_col="context")
    return both.select("doc_id", "cleaned", "wrapped", "ctx.content_type")


# ---- everything at once

_TAIL = "concat(chr(10), chr(10), 'see https://www.example.com/?utm_source=x&q=1 — “now” run_it, then', chr(10), 'stop', chr(8203))"
_TOLD = "see https://example.com/?q=1 -- \"now\" `run_it`, then stop"


@query(expected(_PIECES(D), f"SELECT doc_id, concat({grouped(6, said('g'), f'{NL} || {NL}')}, CASE WHEN p[1] = '' THEN '' ELSE {NL} || {NL} END, '{_TOLD}') AS cleaned, false AS skipped FROM p"))
def full_clean(spark, sf_dir):
    """All stages in their order over whole texts."""
    make = lambda q: f"concat({q.join(q.each(_PIECES(q), f'''concat(x, CASE WHEN i % 6 = 5 THEN {NL} ELSE '' END)'''))}, {_TAIL.replace('chr(8203)', chr(39) + chr(8203) + chr(39))})"
    return cleaned(spark, sf_dir, make, None).select("doc_id", "cleaned", (F.col("ctx.skipped_oversize") | F.col("ctx.skipped_sensitive")).alias("skipped"))


# ---- classification and structure

_WORDS = lambda q: q.add(q.keep(q.each(q.cut(q.letters, 12), "trim(x)"), "x <> ''"), "'omega'", "'psi'", "'alpha'", "'beta'")
_KINDS = ("Json", "Table", "Url", "ShellBlock", "Code", "List", "Prose", "Mixed")


@query(f"SELECT doc_id, [{', '.join(map(repr, _KINDS))}][(doc_id % 8 + 1)::INT] AS content_type FROM documents")
def content_types(spark, sf_dir):
    """What whole documents are, laid out as each kind in turn."""

    def make(q):
        rows = {
            1: q.join(q.each(_WORDS(q), "concat(<i>, chr(9), x)")), 2: "concat('https://example.com/', doc_id)", 3: q.join(q.each(_WORDS(q), "concat('rm -rf /tmp/', replace(x, ' ', '_'))")),
            4: f"concat('#!', {q.join(_WORDS(q))})", 5: q.join(q.each(_WORDS(q), "concat('- ', x)")), 6: q.letters, 7: q.join(_WORDS(q)),
        }
        return "CASE doc_id % 8 WHEN 0 THEN to_json(named_struct('text', coalesce(text, ''))) " + " ".join(f"WHEN {n} THEN {x}" for n, x in rows.items()) + " END"

    return cleaned(spark, sf_dir, make, []).select("doc_id", "ctx.content_type")


_BODY = lambda q: q.join(q.each(q.add(q.cut(q.run, 40), "'omega'", "'psi'"), "concat('    ', x, '=1')"))
_HEAD = {0: f"concat('def f(x):', {NL}, '    import os', {NL}, ", 1: f"concat('#!/bin/x', {NL}, "}


@query(expected("[1]", f"""SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN concat('{FENCE}python', {NL}, {_HEAD[0]}{_BODY(D)}), {NL}, '{FENCE}') ELSE concat('{FENCE}', {NL}, {_HEAD[1]}{_BODY(D)}), {NL}, '{FENCE}') END AS cleaned, 'Code' AS content_type FROM p"""))
def code_fences(spark, sf_dir):
    """Indented code with the words of a language gets its fence, a script one without a name."""
    make = lambda q: f"CASE doc_id % 2 WHEN 0 THEN {_HEAD[0]}{_BODY(q)}) ELSE {_HEAD[1]}{_BODY(q)}) END"
    return cleaned(spark, sf_dir, make, ["structural_detection"]).select("doc_id", "cleaned", "ctx.content_type")


# ---- tables

_ROWS = "SELECT doc_id, i - 1 AS row_no, [(i - 1)::VARCHAR, c] AS cells, {conf} AS confidence FROM (SELECT doc_id, unnest({cells}) AS c, generate_subscripts(p, 1) AS i, n FROM p)"


def rows_of(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    found = docs(spark, sf_dir, made(make)).select("doc_id", text.table_column(F.col("text")).alias("t"))
    return found.select("doc_id", F.round(F.col("t.confidence").cast("double"), 2).alias("confidence"), F.posexplode("t.rows").alias("row_no", "cells")).select("doc_id", "row_no", "cells", "confidence")


_HALVES = "list_transform(p, lambda x: array_to_string(list_filter([trim(substr(x, 1, 6)), trim(substr(x, 7))], lambda y: y <> ''), ' '))"


@query(expected(_WORDS(D), _ROWS.format(cells=_HALVES, conf="0.92")))
def table_terminal(spark, sf_dir):
    """Boxes with wrapped cells: the lines of a row are joined cell by cell."""
    row = f"concat('│ ', <i>, ' │ ', rpad(substr(x, 1, 6), 6, ' '), ' │', {NL}, '│   │ ', rpad(substr(x, 7), 6, ' '), ' │', {NL}, '├───┼────────┤')"
    return rows_of(spark, sf_dir, lambda q: f"concat('┌───┬────────┐', {NL}, {q.join(q.each(_WORDS(q), row))})")


@query(expected(_WORDS(D), _ROWS.format(cells=_HALVES, conf="0.92")))
def table_clipped(spark, sf_dir):
    """Boxes of which every other row lost its left border."""
    row = f"concat(CASE WHEN i % 2 = 1 THEN '' ELSE '│ ' END, <i>, ' │ ', rpad(substr(x, 1, 6), 6, ' '), ' │', {NL}, '│   │ ', rpad(substr(x, 7), 6, ' '), ' │', {NL}, '├───┼────────┤')"
    return rows_of(spark, sf_dir, lambda q: f"concat('┌───┬────────┐', {NL}, {q.join(q.each(_WORDS(q), row))})")


@query(expected(_WORDS(D), _ROWS.format(cells="p", conf="0.84")))
def table_flattened(spark, sf_dir):
    """Boxes that lost their line breaks."""
    return rows_of(spark, sf_dir, lambda q: f"concat('┌───┬───┐ ', {q.join(q.each(_WORDS(q), '''concat('│ ', <i>, ' │ ', x, ' │')'''), chr(39) + ' ├───┼───┤ ' + chr(39))}, ' └───┴───┘')")


@query(expected(_WORDS(D), _ROWS.format(cells="p", conf="0.76")))
def table_aligned(spark, sf_dir):
    """Lines whose bars stand in columns, under a heading that has other ones."""
    return rows_of(spark, sf_dir, lambda q: f"concat('│ a │ b │ c │', {NL}, {q.join(q.each(_WORDS(q), '''concat('│ ', lpad(<i>, 5, ' '), ' │ ', rpad(x, 12, ' '), ' │')'''))})".replace("lpad(i,", "lpad(CAST(i AS STRING),"))


@query(expected(_WORDS(D), "SELECT doc_id, i - 1 AS row_no, CASE doc_id % 3 WHEN 0 THEN [(i - 1)::VARCHAR, c] WHEN 1 THEN [(i - 1)::VARCHAR, c || ', \"x\"', 'z'] ELSE [(i - 1)::VARCHAR, 'say; ' || c] END AS cells, CASE doc_id % 3 WHEN 0 THEN 0.92 WHEN 1 THEN 0.84 ELSE 0.83 END AS confidence FROM (SELECT doc_id, unnest(p) AS c, generate_subscripts(p, 1) AS i FROM p)"))
def table_delimited(spark, sf_dir):
    """Lines with tabs, commas or semicolons, and quoted fields that hold them."""

    def make(q):
        rows = ("concat(<i>, chr(9), x)", "concat(<i>, ',\"', x, ', \"\"x\"\"\",z')", "concat(<i>, ';\"say; ', x, '\"')")
        return "CASE doc_id % 3 " + " ".join(f"WHEN {n} THEN {q.join(q.each(_WORDS(q), r))}" for n, r in enumerate(rows)) + " END"

    return rows_of(spark, sf_dir, make)


_MD_ROWS = "concat('| ', <i>, ' | ', x, ' |')"


@query(expected(_WORDS(D), _ROWS.format(cells="list_transform(p, lambda x: x || ' | y')", conf="0.93")).replace("i - 1 AS row_no, [(i - 1)", "i AS row_no, [(i - 1)") + " UNION ALL SELECT doc_id, 0, ['n', 'piece'], 0.93 FROM documents")
def table_markdown(spark, sf_dir):
    """Markdown with a rule line and escaped bars."""
    return rows_of(spark, sf_dir, lambda q: f"concat('| n | piece |', {NL}, '|---|:---:|', {NL}, {q.join(q.each(_WORDS(q), _MD_ROWS.replace('x,', 'x, ' + chr(39) + ' ' + chr(39) + ', chr(92), ' + chr(39) + '| y' + chr(39) + ','))).replace(chr(39) + ' ' + chr(39) + ', ' + chr(39) + '|', chr(39) + ' |')})")


@query(expected(_WORDS(D), "SELECT doc_id, concat('\"', p[2], '\"') AS cleaned, 'Copied cell r2c2 · Normalized text formatting' AS label FROM p"))
def cell_pick(spark, sf_dir):
    """A cell of a table, cleaned as a text of its own."""
    own = docs(spark, sf_dir, made(lambda q: q.join(q.each(_WORDS(q), "concat(<i>, chr(9), '“', x, '”')"))))
    picked = own.select("doc_id", text.table_column(F.col("text")).alias("t")).select("doc_id", cleaner.clean_cell(F.col("t.rows"), 1, 1).alias("c"))
    return picked.select("doc_id", "c.*")


# ---- URLs and rules in whole texts

_SAFE = "replace(replace(text, 'http', 'h_ttp'), '`', '.')"
_URLS = f"""'see https://www.Example.com/a/../b?utm_source=n&q=1#f, (https://x.org/?si=5&k=)', {NL}, '`https://www.a.org/?gclid=1` https://www.a.org/?gclid=1', {NL}, '{FENCE}', {NL}, 'https://www.a.org/?fbclid=2', {NL}, '{FENCE}'"""
_CLEAN_URLS = f"""'see https://example.com/b?q=1#f, (https://x.org/?si=5)', {NL}, '`https://www.a.org/?gclid=1` https://a.org', {NL}, '{FENCE}', {NL}, 'https://www.a.org/?fbclid=2', {NL}, '{FENCE}'"""


@query(f"SELECT doc_id, concat({_SAFE}, {NL}, {_CLEAN_URLS}) AS cleaned FROM documents")
def url_text(spark, sf_dir):
    """URLs in whole texts: in fences and backticks they stay; a domain keeps one parameter and denies another."""
    config = Config(Settings(sensitive_filter=False), domains={"x.org": {"keep": ["si"], "deny": ["k"]}})
    return cleaned(spark, sf_dir, lambda q: f"concat({_SAFE}, {NL}, {_URLS})", ["url_cleaning"], config).select("doc_id", "cleaned")


_SWAPPED = r"""regexp_replace(regexp_replace(regexp_replace(text, '([a-z]+)ing ', '\1ING ', 'g'), '([A-Z][a-z]+)\. ([A-Z][a-z]+)', '\2. \1', 'g'), 'the ', '$1 ', 'g')"""


@query(f"SELECT doc_id, concat({_SWAPPED}, '!') AS cleaned FROM documents")
def rules_stage(spark, sf_dir):
    """Rules in their order over whole texts, by the stage; the last one adds a sign at the end of the text alone."""
    config = Config(Settings(sensitive_filter=False), rules=(*RULES, Rule("end", "$", "!")))
    return cleaned(spark, sf_dir, lambda q: "text", ["user_rules"], config).select("doc_id", "cleaned")


# ---- rich text

_HTML = "concat('<head><title>no</title></head><p>', replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</p><ul><li>one <code>a_b</code></li><li><b style=\"color:red\">two</b></li></ul><pre>x  y</pre>')"
_RICH = f"concat(regexp_replace(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '(.)$', '\\1' || {NL}), '- one `a_b`', {NL}, '- two', {NL}, '{FENCE}', {NL}, 'x  y', {NL}, '{FENCE}')"


@query(f"SELECT doc_id, {_RICH} AS text FROM documents WHERE text IS NOT NULL")
def rich_text(spark, sf_dir):
    """Whole texts as HTML, with a list, code and a fence."""
    own = docs(spark, sf_dir).where("text is not null")
    return own.select("doc_id", text.html_column(F.expr(_HTML.format(x="text"))).alias("text"))


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {_RICH} WHEN 1 THEN text WHEN 2 THEN text || text || text || 'tail tail tail tail tail tail tail tail tail tail tail tail tail tail' ELSE 'use `run_it`' END AS text FROM documents WHERE text <> ''")
def rich_candidates(spark, sf_dir):
    """The better of two forms: the rich one, the plain one where there is no rich one or it lost too much, or the rich one alone with backticks."""
    own = docs(spark, sf_dir).where("text <> ''")
    html = F.expr(f"CASE doc_id % 4 WHEN 0 THEN {_HTML.format(x='text')} WHEN 1 THEN '' WHEN 2 THEN {_HTML.format(x='text')} ELSE '<p>use run_it</p>' END")
    plain = F.expr("CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN concat(text, text, text, 'tail tail tail tail tail tail tail tail tail tail tail tail tail tail') END")
    return own.select("doc_id", text.candidate_column(html, plain).alias("text"))
