"""Queries over the driver's tables, one for each operator or group of operators, and the same in DuckDB SQL.

Documents have few of the characters that the stages act on, so some queries first dirty the text by a projection on doc_id; that
projection is one SQL text for both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native
from ..functions.chars import EXCLUDED_APPS, INVISIBLE, KEYWORDS, MOJIBAKE, PLAIN, RECORDING_DOT, SECRETS, SHELL_WORDS, TRACKING, WHITE, words_of
from ..operators import cleaner, diff, layout
from ..operators import codespans as codespans_
from ..operators.base import LABELS
from ..operators.rules import Rule, compiled, java_replacement
from ..sources import history, text
from ..sources.config import Config, Settings
from ..streaming import taps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parted(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is a scan of fewer files than half of them, which would leave most cores idle; others stay as they
    are. Looks at file names only, so it runs no job."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * len(df.inputFiles()) <= cores else df


def docs(spark: SparkSession, sf_dir: str, dirty: str | None = None) -> DataFrame:
    own = parted(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return own.withColumn("text", F.expr(dirty)) if dirty else own


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- dirtying projections

DIRTY_CHARS = "CASE doc_id % 4 WHEN 0 THEN concat('“', text, '”') WHEN 1 THEN replace(text, ' ', chr(160)) WHEN 2 THEN replace(text, ', ', '—') ELSE concat(text, '​', '–') END"
DIRTY_ANSI = f"CASE doc_id % 3 WHEN 0 THEN concat(chr(27), '[31m', text, chr(27), '[0m') WHEN 1 THEN concat('  {RECORDING_DOT * 2} ', replace(text, chr(10), concat(chr(10), ' {RECORDING_DOT} '))) ELSE concat(chr(27), '[?25l', text, '‍') END"
DIRTY_MOJIBAKE = f"CASE doc_id % 3 WHEN 0 THEN concat('{MOJIBAKE[0][0]} {MOJIBAKE[1][0]} {MOJIBAKE[2][0]} ', text, chr(10), chr(10), '{MOJIBAKE[0][0]}') WHEN 1 THEN concat('{MOJIBAKE[3][0]}', text) ELSE text END"
DIRTY_SECRET = "CASE doc_id % 9 WHEN 0 THEN concat(text, ' AK', 'IA', repeat('Q', 16)) WHEN 1 THEN concat('gh', 'p_', repeat('a', 36), text) WHEN 2 THEN concat('xo', 'xb-', repeat('1', 12)) WHEN 3 THEN concat('ey', 'J', repeat('a', 12), '.', repeat('b', 12)) WHEN 4 THEN repeat('Zz9+', 11) WHEN 5 THEN concat('-----BEGIN ', 'CERTIFICATE-----') WHEN 6 THEN concat('s', 'k-', repeat('c', 24)) ELSE text END"
DIRTY_LINES = "CASE doc_id % 5 WHEN 0 THEN concat('- ', replace(text, chr(10), concat(chr(10), '- '))) WHEN 1 THEN concat('    ', replace(text, '.', ';'), chr(10), '  a', chr(10), '  b', chr(10), '  c') WHEN 2 THEN concat('1. ', replace(text, chr(10), concat(chr(10), '2) '))) WHEN 3 THEN concat('#!', text, chr(10), 'x', chr(10), 'y', chr(10), 'z') ELSE text END"
DIRTY_CODE = "CASE doc_id % 6 WHEN 0 THEN concat('def ', text, ' import os print(') WHEN 1 THEN concat('fn main let mut a::b ', text) WHEN 2 THEN concat('const a = b => ', text, ' require(') WHEN 3 THEN concat('func f var x ', text) WHEN 4 THEN concat('package main fmt.P := ', text) ELSE concat('public class A private ', text) END"
DIRTY_TOKENS = "concat(text, CASE doc_id % 8 WHEN 0 THEN ' --flag' WHEN 1 THEN ' snake_case' WHEN 2 THEN ' ./run.sh' WHEN 3 THEN ' camelCase' WHEN 4 THEN ' SCREAMING' WHEN 5 THEN ' host.name:8080' WHEN 6 THEN ' $HOME' ELSE ' a.b.cd' END)"
DIRTY_COMMANDS = "CASE doc_id % 6 WHEN 0 THEN concat('git commit -m ', lang) WHEN 1 THEN concat('sudo rm ', source, ' /tmp/x') WHEN 2 THEN concat('open the ', lang) WHEN 3 THEN concat('./run ', source) WHEN 4 THEN concat('`ls ~', lang, '`') ELSE concat('  cat ', source, '   ') END"

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || " + " || ".join(f"chr({ord(c)})" for c in WHITE if ord(c) > 160)
_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_INLINE = r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_trim(x: str) -> str:
    return f"trim({x}, {_TRIM})"


def sql_plain(x: str) -> str:
    return f"replace(translate({x}, {q(''.join(PLAIN) + INVISIBLE)}, {q(''.join(PLAIN.values()))}), '—', '--')"


def sql_ansi(x: str) -> str:
    return rf"regexp_replace({x}, '\x1B\[[0-9;]*[A-Za-z]', '', 'g')"


def sql_dots(x: str) -> str:
    return rf"regexp_replace({x}, '(?m)^([{_INLINE}]*){RECORDING_DOT}+[{_INLINE}]*', '\1', 'g')"


def sql_invisible(x: str) -> str:
    return f"translate({x}, '{INVISIBLE}', '')"


def sql_secret(x: str) -> str:
    own = sql_trim(x)
    return "CASE " + " ".join(f"WHEN regexp_matches({own}, {q(p.removesuffix('$') + chr(92) + 'z' if p.endswith('$') else p)}) THEN '{name}'" for name, p in SECRETS) + " END"


#: All stages, without the guard against secrets: queries that state what becomes of a text need it cleaned.
OPEN = Config(Settings(sensitive_filter=False, auto_wrapper=True))

# ---- guards and characters

CLEANED = sql_invisible(sql_dots(sql_ansi(sql_plain("t"))))


@query(f"""
SELECT lang, count(*) AS n_docs, sum(strlen(t))::BIGINT AS bytes_in, sum(strlen({CLEANED}))::BIGINT AS bytes_out, count(*) FILTER (strlen(t) > 4000) AS n_oversize,
  count(*) FILTER ({sql_secret("t")} IS NOT NULL) AS n_sensitive
FROM (SELECT lang, {DIRTY_ANSI} AS t FROM documents) GROUP BY lang""")
def clean_summary(spark, sf_dir):
    """The flagship: guards and character stages, by language."""
    own = docs(spark, sf_dir, DIRTY_ANSI)
    out = native.without_artifacts(native.plain_characters(F.col("text")))
    flagged = own.select("lang", F.octet_length("text").alias("i"), F.octet_length(out).alias("o"), native.is_oversize(F.col("text"), 4000).cast("int").alias("big"), native.has_secret(F.col("text")).cast("int").alias("secret"))
    return flagged.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("i").alias("bytes_in"), F.sum("o").alias("bytes_out"), F.sum("big").alias("n_oversize"), F.sum("secret").alias("n_sensitive"))


@query(f"SELECT doc_id, strlen(text) > 4000 AS oversize, {sql_secret('text')} IS NOT NULL AS sensitive FROM documents")
def guard_flags(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", native.is_oversize(t, 4000).alias("oversize"), native.has_secret(t).alias("sensitive"))


@query(f"SELECT doc_id, {sql_secret('t')} AS pattern FROM (SELECT doc_id, {DIRTY_SECRET} AS t FROM documents)")
def secret_pattern_hit(spark, sf_dir):
    return docs(spark, sf_dir, DIRTY_SECRET).select("doc_id", native.secret_name(F.col("text")).alias("pattern"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND 3 * strlen(text) > 2 * strlen(text) THEN text WHEN doc_id % 2 = 0 THEN repeat(text, 3) ELSE concat(text, text) END AS text FROM documents")
def expansion_guard(spark, sf_dir):
    t = F.col("text")
    grown = F.when(F.col("doc_id") % 2 == 0, F.repeat(t, F.lit(3))).otherwise(F.concat(t, t))
    return docs(spark, sf_dir).select("doc_id", native.within_expansion(grown, t).alias("text"))


@query(f"SELECT source, count(*) AS n_docs FROM (SELECT CASE doc_id % 7 WHEN 0 THEN '{EXCLUDED_APPS[0]}' WHEN 1 THEN '{EXCLUDED_APPS[3]}' ELSE source END AS source FROM documents) WHERE source NOT IN ({', '.join(map(q, EXCLUDED_APPS))}) GROUP BY source")
def excluded_sources(spark, sf_dir):
    own = docs(spark, sf_dir).select(F.expr(f"CASE doc_id % 7 WHEN 0 THEN '{EXCLUDED_APPS[0]}' WHEN 1 THEN '{EXCLUDED_APPS[3]}' ELSE source END").alias("source"))
    return own.where(~native.is_excluded(F.col("source"), EXCLUDED_APPS)).groupBy("source").agg(F.count("*").alias("n_docs"))


@query(f"SELECT doc_id, {sql_plain('t')} AS text FROM (SELECT doc_id, {DIRTY_CHARS} AS t FROM documents)")
def char_normalize(spark, sf_dir):
    return docs(spark, sf_dir, DIRTY_CHARS).select("doc_id", native.plain_characters(F.col("text")).alias("text"))


_DECOMPOSED = "concat(replace(text, 'e', concat('e', chr(769))), 'A', chr(778), '“')"


@query(f"SELECT doc_id, nfc_normalize({sql_plain('t')}) AS cleaned FROM (SELECT doc_id, {_DECOMPOSED} AS t FROM documents)")
def nfc(spark, sf_dir):
    """Characters and composition by the Unicode stage."""
    own = docs(spark, sf_dir, _DECOMPOSED.replace("chr(769)", "'\u0301'").replace("chr(778)", "'\u030a'")).select("doc_id", "text")
    return cleaner.clean(own, config=OPEN, names=["normalize_unicode"]).select("doc_id", "cleaned")


def _sql_mojibake() -> str:
    fixed = "p"
    for bad, good in MOJIBAKE:
        fixed = f"replace({fixed}, {q(bad)}, {q(good)})"
    hits = " + ".join(f"contains(p, {q(bad)})::INT" for bad, _ in MOJIBAKE)
    return f"SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10) || chr(10)), lambda p: CASE WHEN {hits} >= 3 THEN {fixed} ELSE p END), chr(10) || chr(10)) AS text FROM (SELECT doc_id, {DIRTY_MOJIBAKE} AS t FROM documents)"


@query(_sql_mojibake())
def mojibake_repair(spark, sf_dir):
    return docs(spark, sf_dir, DIRTY_MOJIBAKE).select("doc_id", native.repaired_mojibake(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {sql_ansi('t')} AS text, strlen(t) - strlen({sql_ansi('t')}) AS bytes_removed FROM (SELECT doc_id, {DIRTY_ANSI} AS t FROM documents)")
def ansi_strip(spark, sf_dir):
    out = native.without_ansi(F.col("text"))
    return docs(spark, sf_dir, DIRTY_ANSI).select("doc_id", out.alias("text"), native.bytes_changed(out, F.col("text")).alias("bytes_removed"))


@query(f"SELECT doc_id, {sql_dots('t')} AS text FROM (SELECT doc_id, {DIRTY_ANSI} AS t FROM documents)")
def recording_dot(spark, sf_dir):
    return docs(spark, sf_dir, DIRTY_ANSI).select("doc_id", native.without_recording_dots(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {sql_invisible('t')} AS text FROM (SELECT doc_id, {DIRTY_ANSI} AS t FROM documents)")
def zero_width_strip(spark, sf_dir):
    return docs(spark, sf_dir, DIRTY_ANSI).select("doc_id", native.without_invisible(F.col("text")).alias("text"))


# ---- lines, classifier, code

_FILLED = "list_filter(string_split(t, chr(10)), lambda x: x <> '')"
_ITEM = rf"regexp_matches({sql_trim('x')}, '^(- |\* |[•◦▪][{_WS}]|\p{{Nd}}+[.)\]] )')"
_SENTENCE = rf"regexp_matches({sql_trim('x')}, '[.?!]\z')"
_INDENTED = r"regexp_matches(x, '^[ \t]')"


def sql_share(test: str) -> str:
    return f"CASE WHEN len({_FILLED}) > 0 THEN len(list_filter({_FILLED}, lambda x: {test})) * 100 // len({_FILLED}) ELSE 0 END"


@query(f"SELECT doc_id, len(string_split(t, chr(10))) AS n_lines, len({_FILLED}) AS n_filled, {sql_share(_ITEM)} AS list_percent, {sql_share(_SENTENCE)} AS sentence_percent, {sql_share(_INDENTED)} AS indent_percent FROM (SELECT doc_id, {DIRTY_LINES} AS t FROM documents)")
def line_stats(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir, DIRTY_LINES).select(
        "doc_id", F.size(native.lines(t)).cast("bigint").alias("n_lines"), F.size(native.filled_lines(t)).cast("bigint").alias("n_filled"),
        *[native.share_of_lines(t, test).cast("bigint").alias(name) for name, test in (("list_percent", lambda x: native.is_list_item(native.trimmed(x))), ("sentence_percent", native.ends_sentence), ("indent_percent", native.is_indented))],
    )


@query(f"""SELECT doc_id, len(string_split(t, chr(10))) > 3 AND (starts_with(t, '#!') OR ({sql_share(_INDENTED)} >= 40 AND {sql_share(_SENTENCE)} < 30)) AS code_like,
  len({_FILLED}) >= 2 AND {sql_share(_ITEM)} >= 60 AS list_like FROM (SELECT doc_id, {DIRTY_LINES} AS t FROM documents)""")
def classify_lines(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir, DIRTY_LINES).select("doc_id", native.looks_like_code(t).alias("code_like"), native.looks_like_list(t).alias("list_like"))


_WIDTHS = f"""WITH l AS (SELECT doc_id, length(rtrim(line, {_TRIM})) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
c AS (SELECT doc_id, n, count(*) OVER (PARTITION BY doc_id ORDER BY n RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS c, max(n) OVER (PARTITION BY doc_id ORDER BY n RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM l WHERE n > 40),
m AS (SELECT doc_id, max(c) AS cluster, count(*) AS long_lines FROM c GROUP BY doc_id),
t AS (SELECT doc_id, list_reduce(list({{'n': n, 'w': w}} ORDER BY n), lambda a, x: CASE WHEN x.n > a.w THEN x ELSE a END).w AS width FROM (SELECT DISTINCT doc_id, n, w, c FROM c) JOIN m USING (doc_id) WHERE c = cluster GROUP BY doc_id),
b AS (SELECT * FROM m JOIN t USING (doc_id))"""


@query(_WIDTHS + " SELECT doc_id, cluster::INT AS cluster, long_lines::INT AS long_lines, CASE WHEN cluster >= 3 THEN width ELSE 0 END::INT AS width FROM b")
def width_clusters(spark, sf_dir):
    """The largest cluster of line lengths of each document, of which the unwrapper takes the terminal's width: a fold within the row."""
    found = docs(spark, sf_dir).select("doc_id", F.array(native.width_cluster(F.col("text"))).alias("w"))
    return found.select("doc_id", F.inline(F.filter("w", lambda w: w.isNotNull())))  # a filter would compute it once more


@query(_WIDTHS + " SELECT doc_id, CASE WHEN cluster >= 3 THEN width ELSE 0 END::INT AS width FROM documents LEFT JOIN b USING (doc_id)")
def terminal_width(spark, sf_dir):
    """The same by the layout stage's own function."""

    @F.pandas_udf("int")
    def width(s):
        return s.map(lambda t: layout.terminal_width(t.split("\n")) if t is not None else 0)

    return docs(spark, sf_dir).select("doc_id", width("text").alias("width"))


def _sql_score(x: str) -> str:
    return " + ".join(f"(length(t) - length(replace(t, {q(k)}, ''))) // {len(k)}" for k in KEYWORDS[x])


@query(f"SELECT doc_id, {', '.join(f'({_sql_score(x)})::INT AS {x}' for x in KEYWORDS)} FROM (SELECT doc_id, {DIRTY_CODE} AS t FROM documents)")
def language_scores(spark, sf_dir):
    return docs(spark, sf_dir, DIRTY_CODE).select("doc_id", *[native.keyword_score(F.col("text"), x).alias(x) for x in KEYWORDS])


@query(f"""WITH s AS (SELECT doc_id, {', '.join(f'({_sql_score(x)}) * 10 + {i} AS {x}' for i, x in enumerate(KEYWORDS))} FROM (SELECT doc_id, {DIRTY_CODE} AS t FROM documents)),
g AS (SELECT doc_id, greatest({', '.join(KEYWORDS)}) AS g FROM s)
SELECT doc_id, CASE WHEN g // 10 >= 2 THEN [{', '.join(map(q, KEYWORDS))}][(g % 10 + 1)::INT] END AS language FROM g""")
def code_language(spark, sf_dir):
    return docs(spark, sf_dir, DIRTY_CODE).select("doc_id", native.language(F.col("text")).alias("language"))


_TOKENS = f"SELECT doc_id, list_filter(regexp_split_to_array(t, '[{_WS}]+'), lambda x: x <> '') AS w FROM (SELECT doc_id, {DIRTY_TOKENS} AS t FROM documents)"


@query(f"""SELECT doc_id, len(w)::INT AS n_tokens, len(list_filter(w, lambda x: strlen(x) BETWEEN 2 AND 100 AND NOT contains(x, '`') AND NOT regexp_matches(x, '^https?://') AND regexp_matches(x, {q(native.CODE_TOKEN)})))::INT AS n_code FROM ({_TOKENS})""")
def code_token_flags(spark, sf_dir):
    """Words and code-like words of each document, counted within the row."""
    own = docs(spark, sf_dir, DIRTY_TOKENS)
    return own.select("doc_id", F.size(native.words(F.col("text"))).alias("n_tokens"), native.code_token_count(F.col("text")).alias("n_code"))


OLDER_TOKEN = r"^--|_|^\.{0,2}/|/.*[.:-]|[.:-].*/|^[A-Za-z0-9._-]+\.[A-Za-z0-9]{1,8}(:\p{Nd}+)?$|^[A-Za-z]+[A-Z][A-Za-z0-9]*$|^[A-Z][A-Z0-9_]{2,}$"


@query(f"""SELECT doc_id, len(list_filter(w, lambda x: length(x) BETWEEN 2 AND 100 AND NOT contains(x, '`') AND NOT regexp_matches(x, '^https?://') AND regexp_matches(x, {q(OLDER_TOKEN)})))::INT AS n_code FROM ({_TOKENS})""")
def older_code_tokens(spark, sf_dir):
    """Code-like words by the older rules."""

    @F.pandas_udf("int")
    def count(s):
        return s.map(lambda t: sum(map(codespans_.is_older_code_token, words_of(t))) if t is not None else 0)

    return docs(spark, sf_dir, DIRTY_TOKENS).select("doc_id", count("text").alias("n_code"))


_COMMAND = f"""WITH o AS (SELECT doc_id, {sql_trim("t")} AS o FROM (SELECT doc_id, {DIRTY_COMMANDS} AS t FROM documents)),
i AS (SELECT doc_id, o, CASE WHEN regexp_matches(o, '(?s)^`.+`$') AND strlen(o) > 2 THEN substr(o, 2, length(o) - 2) ELSE o END AS i FROM o),
w AS (SELECT doc_id, o, list_filter(regexp_split_to_array(i, '[{_WS}]+'), lambda x: x <> '') AS w FROM i),
c AS (SELECT doc_id, o, w, CASE WHEN w[1] = 'sudo' THEN coalesce(w[2], '') ELSE w[1] END AS c FROM w)
SELECT doc_id, coalesce(starts_with(c, './') OR (c IN ({", ".join(map(q, SHELL_WORDS))}) AND len(list_filter(w[2:], lambda x: regexp_matches(x, '/|^[~$]|^-.'))) > 0), false) AS command FROM c"""


@query(_COMMAND)
def shell_commands(spark, sf_dir):
    return docs(spark, sf_dir, DIRTY_COMMANDS).select("doc_id", native.is_shell_command(F.col("text")).alias("command"))


@query(f"""SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN {sql_trim("x")} = '' OR starts_with({sql_trim("x")}, '#') OR (starts_with({sql_trim("x")}, '`') AND ends_with({sql_trim("x")}, '`')) THEN x ELSE concat('`', {sql_trim("x")}, '`') END), chr(10)) AS text FROM (SELECT doc_id, concat({DIRTY_COMMANDS}, chr(10), '# note', chr(10), ' ls ') AS t FROM documents)""")
def wrapped_commands(spark, sf_dir):
    return docs(spark, sf_dir, f"concat({DIRTY_COMMANDS}, chr(10), '# note', chr(10), ' ls ')").select("doc_id", native.wrapped_commands(F.col("text")).alias("text"))


_PADDED = "concat(repeat(' ', CAST(doc_id % 30 AS INT)), lang, '    ', source, '  x   ')"


@query(f"SELECT doc_id, CASE WHEN doc_id % 30 > 20 THEN '' ELSE repeat(' ', (doc_id % 30)::INT) END || lang || ' ' || source || '  x' AS line FROM documents")
def collapsed_padding(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", native.collapsed_padding(F.expr(_PADDED)).alias("line"))


RULES = (Rule("endings", "([a-z]+)ing ", "${1}ING "), Rule("swap", "([A-Z][a-z]+)\\. ([A-Z][a-z]+)", "${2}. $1"), Rule("dollars", "the ", "$$1 "))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([a-z]+)ing ', '\1ING ', 'g'), '([A-Z][a-z]+)\. ([A-Z][a-z]+)', '\2. \1', 'g'), 'the ', '$1 ', 'g') AS text FROM documents""")
def user_rules(spark, sf_dir):
    out = F.col("text")
    for r in RULES:
        p = compiled(r)
        out = F.regexp_replace(out, r.pattern, java_replacement(r.replacement, p))
    return docs(spark, sf_dir).select("doc_id", out.alias("text"))


# ---- URLs

_DIRTY_URL = "concat(url, CASE WHEN contains(url, '?') OR contains(url, '#') THEN '' ELSE CASE page_id % 3 WHEN 0 THEN '?utm_id=1&a=2' WHEN 1 THEN '?si=3' ELSE '' END END)"
_TRACKS = f"(split_part(x, '=', 1) IN ({', '.join(map(q, TRACKING))}) OR starts_with(x, 'utm_'))"
_URL_PARTS = rf"""WITH u AS (SELECT page_id, {_DIRTY_URL} AS url FROM pages),
p AS (SELECT page_id, url, lower(regexp_extract(url, '^(https?)://', 1)) AS s, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.(.)', '\1') AS h,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '') AS q, regexp_extract(url, '(#.*)$', 1) AS f FROM u)"""


@query(_URL_PARTS + rf""", k AS (SELECT *, list_transform(list_filter(q, lambda x: NOT {_TRACKS}), lambda x: regexp_replace(x, '=$', '')) AS k FROM p),
o AS (SELECT page_id, url, s, concat(s, '://', h, CASE p WHEN '' THEN '/' ELSE p END, CASE WHEN len(k) > 0 THEN concat('?', array_to_string(k, '&')) ELSE '' END, f) AS o FROM k)
SELECT page_id, CASE WHEN s = '' THEN url WHEN ends_with(o, '/') AND NOT ends_with(url, '/') THEN substr(o, 1, length(o) - 1) ELSE o END AS url FROM o""")
def url_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", native.clean_url(F.expr(_DIRTY_URL)).alias("url"))


@query(_URL_PARTS + f"SELECT split_part(x, '=', 1) AS param, count(*) AS n FROM (SELECT unnest(q) AS x FROM p) WHERE {_TRACKS} GROUP BY 1")
def url_params_dropped(spark, sf_dir):
    query_ = F.regexp_extract(F.expr(_DIRTY_URL), r"^[^?#]*\?([^#]*)", 1)
    keys = table(spark, sf_dir, "pages").select(F.explode(F.filter(F.split(query_, "&", -1), lambda x: x != "")).alias("x")).select(F.substring_index("x", "=", 1).alias("param"))
    return keys.where(native.tracks(F.col("param"))).groupBy("param").agg(F.count("*").alias("n"))


# ---- Python stages, fused


@query(f"SELECT doc_id, {sql_invisible(sql_dots(sql_ansi('t')))} AS cleaned, {sql_invisible(sql_dots(sql_ansi('t')))} <> t AS fired FROM (SELECT doc_id, {DIRTY_ANSI} AS t FROM documents)")
def artifact_stage(spark, sf_dir):
    """The artifact stage, and whether it fired."""
    out = cleaner.clean(docs(spark, sf_dir, DIRTY_ANSI).select("doc_id", "text"), config=OPEN, names=["agent_strip"])
    return out.select("doc_id", "cleaned", (F.size("ctx.rules_fired") > 0).alias("fired"))


@query(_sql_mojibake().replace("AS text FROM (", "AS cleaned FROM ("))
def mojibake_stage(spark, sf_dir):
    """Misread paragraphs by the Unicode stage; the texts have nothing else that it would change."""
    own = docs(spark, sf_dir, DIRTY_MOJIBAKE).select("doc_id", "text")
    return cleaner.clean(own, config=Config(Settings(sensitive_filter=False, em_dash="")), names=["normalize_unicode"]).select("doc_id", "cleaned")


@query()
def clean_documents(spark, sf_dir):
    """All stages and guards over dirtied documents, with the context of each row."""
    return cleaner.clean(docs(spark, sf_dir, DIRTY_CHARS).select("doc_id", "text"), config=Config(Settings(auto_wrapper=True)))


@query()
def layout_documents(spark, sf_dir):
    return cleaner.clean(docs(spark, sf_dir).select("doc_id", "text"), names=["whitespace_cleanup"]).select("doc_id", "cleaned")


@query("SELECT doc_id, concat('{', chr(10), '  \"a\": [', chr(10), '    ', doc_id, ',', chr(10), '    null', chr(10), '  ],', chr(10), '  \"lang\": \"', lang, '\"', chr(10), '}') AS cleaned, 'Json' AS content_type FROM documents")
def json_pretty(spark, sf_dir):
    own = docs(spark, sf_dir, """concat('{"lang":    "', lang, '",  "a":   [', doc_id, ' ,   null ]}')""").select("doc_id", "text")
    return cleaner.clean(own, names=["structural_detection"]).select("doc_id", "cleaned", "ctx.content_type")


@query("SELECT doc_id, concat('| number of the document | its language |', chr(10), '| --- | --- |', chr(10), '| ', doc_id, ' | ', lang, ' |', chr(10), '| source | ', source, ' |') AS cleaned FROM documents")
def markdown_of_delimited(spark, sf_dir):
    own = docs(spark, sf_dir, "concat('number of the document', chr(9), 'its language', chr(10), doc_id, chr(9), lang, chr(10), 'source', chr(9), source)").select("doc_id", "text")
    return cleaner.clean(own, names=["structural_detection"]).select("doc_id", "cleaned")


@query("SELECT doc_id, concat(lang, ' `snake_case` (`--flag`), `run(x)`. `', source, '.py`') AS cleaned FROM documents")
def codespans(spark, sf_dir):
    own = docs(spark, sf_dir, "concat(lang, ' snake_case (--flag), run(x). ', source, '.py')").select("doc_id", "text")
    return cleaner.clean(own, config=Config(Settings(auto_wrapper=True)), names=["auto_wrapper"]).select("doc_id", "cleaned")


_MD = "concat('| doc | lang |', chr(10), '|:---|---:|', chr(10), '| ', doc_id, ' | ', lang, ' |')"


@query("SELECT doc_id, 'markdown' AS format, 0.93::FLOAT AS confidence, r AS row_no, CASE r WHEN 0 THEN 'doc' ELSE doc_id::VARCHAR END AS c0, CASE r WHEN 0 THEN 'lang' ELSE lang END AS c1 FROM documents, (SELECT unnest([0, 1])::INT AS r)")
def table_rows(spark, sf_dir):
    found = docs(spark, sf_dir, _MD).select("doc_id", text.table_column(F.col("text")).alias("t"))
    rows = found.select("doc_id", "t.format", "t.confidence", F.posexplode("t.rows").alias("row_no", "r"))
    return rows.select("doc_id", "format", "confidence", "row_no", F.get("r", F.lit(0)).alias("c0"), F.get("r", F.lit(1)).alias("c1"))


@query("SELECT doc_id, doc_id % 2 = 0 AS detected, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'table confidence 0.78 below threshold 0.80' END AS warning, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS cell FROM documents")
def table_gate(spark, sf_dir):
    """Tables without a rule line are less sure; the gate clears them."""
    own = docs(spark, sf_dir, f"CASE doc_id % 2 WHEN 0 THEN {_MD} ELSE concat('doc | lang', chr(10), doc_id, ' | ', lang) END")
    found = own.select("doc_id", text.table_column(F.col("text")).alias("t")).select("doc_id", native.gated(F.col("t"), True, 0.8).alias("t"))
    return found.select("doc_id", "t.detected", F.array_join("t.warnings", "; ").alias("warning"), native.cell(F.col("t.rows"), 1, 1).alias("cell"))


@query("SELECT doc_id FROM documents WHERE contains(lower(lang), 'e') OR contains(lower(source), 'e')")
def picker_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(native.row_matches(F.array("lang", "source"), " E ")).select("doc_id")


@query()
def rich_pages(spark, sf_dir):
    return parted(table(spark, sf_dir, "pages")).select("page_id", text.html_column(F.col("html")).alias("text"))


_NUMBERED = "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"""WITH l AS ({_NUMBERED}), r AS (SELECT doc_id, i, concat(i, ' ', line) AS line, n FROM l WHERE n >= 2)
SELECT doc_id, (i + 1 + (i + 1) // 3)::INT AS line_no, CASE WHEN i % 3 = 1 THEN '-' ELSE ' ' END AS sign, line FROM r
UNION ALL SELECT doc_id, (i + 2 + (i + 1) // 3)::INT, '+', concat(line, ' +') FROM r WHERE i % 3 = 1""")
def preview_diff(spark, sf_dir):
    """The diff of whole texts, of which every third line changes."""
    before = "array_join(transform(split(text, chr(10), -1), (x, i) -> concat(i, ' ', x)), chr(10))"
    after = "array_join(transform(split(text, chr(10), -1), (x, i) -> concat(i, ' ', x, CASE WHEN i % 3 = 1 THEN ' +' ELSE '' END)), chr(10))"
    return diff.diff_rows(docs(spark, sf_dir).select("doc_id", F.expr(before).alias("before"), F.expr(after).alias("after")), "before", "after", ("doc_id",))


@query()
def unwrapping_diff(spark, sf_dir):
    """The lines that unwrapping takes away and brings."""
    own = cleaner.clean(docs(spark, sf_dir).select("doc_id", "text"), names=["whitespace_cleanup"])
    return diff.diff_rows(own, "text", "cleaned", ("doc_id",))


@query("""SELECT doc_id, CASE WHEN a AND b AND c THEN 'Normalized text formatting · Removed hidden characters +1 more' WHEN a AND b THEN 'Normalized text formatting · Removed hidden characters' WHEN a AND c THEN 'Normalized text formatting · Applied custom rules'
  WHEN b AND c THEN 'Removed hidden characters · Applied custom rules' WHEN a THEN 'Normalized text formatting' WHEN b THEN 'Removed hidden characters' WHEN c THEN 'Applied custom rules' ELSE 'No changes needed' END AS summary
FROM (SELECT doc_id, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b, doc_id % 5 = 0 AS c FROM documents)""")
def summary_label(spark, sf_dir):
    fired = F.array_compact(F.array(*[F.when(F.col("doc_id") % n == 0, F.lit(s)) for n, s in ((2, "normalize_unicode"), (2, "normalize_unicode"), (3, "agent_strip"), (5, "user_rules"))]))
    return docs(spark, sf_dir).select("doc_id", native.summary(fired, LABELS).alias("summary"))


@query(f"""SELECT stage, count(*) AS n, sum(c)::BIGINT AS chars_changed FROM (
  SELECT 'normalize_unicode' AS stage, CASE WHEN strlen(o) <> strlen(t) THEN abs(strlen(o) - strlen(t)) ELSE 1 END AS c FROM (SELECT t, nfc_normalize({sql_plain("t")}) AS o FROM (SELECT {DIRTY_CHARS} AS t FROM documents)) WHERE o <> t) GROUP BY stage""")
def rules_fired_summary(spark, sf_dir):
    own = cleaner.clean(docs(spark, sf_dir, DIRTY_CHARS).select("doc_id", "text"), names=["normalize_unicode"])
    fired = own.select(F.explode("ctx.rules_fired").alias("r")).select("r.*")
    return fired.groupBy("stage").agg(F.count("*").alias("n"), F.sum("chars_changed").alias("chars_changed"))


# ---- history

_HISTORY = "(SELECT conv_id * 1000 + turn AS id, text AS raw_text, text AS cleaned_text, role AS content_type, 1700000000 + (conv_id * 1000 + turn) % 5000 AS created_at, turn % 7 <> 3 AS committed FROM conversations)"


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    own = own.withColumn("created_at", 1_700_000_000 + F.col("id") % 5000)
    rows = history.prepared(own, raw_col="text", cleaned_col="text", type_col="role", store_raw=True)
    return rows.withColumn("committed", F.col("id") % 1000 % 7 != 3)


@query(f"SELECT id, sha256(raw_text) AS raw_hash, content_type, CASE WHEN length(f) > 80 THEN concat(substr(f, 1, 77), '...') ELSE f END AS preview, created_at FROM (SELECT *, replace(cleaned_text, chr(10), ' ') AS f FROM {_HISTORY})")
def history_prepare(spark, sf_dir):
    return history_rows(spark, sf_dir).select("id", "raw_hash", "content_type", "preview", "created_at")


@query(f"SELECT id, created_at FROM {_HISTORY} WHERE committed ORDER BY created_at DESC, id DESC LIMIT 20")
def history_recent(spark, sf_dir):
    return history.recent(history_rows(spark, sf_dir), 20).select("id", "created_at")


@query(f"SELECT id, created_at FROM {_HISTORY} WHERE committed AND contains(translate(cleaned_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ')")
def history_search(spark, sf_dir):
    return history.search(history_rows(spark, sf_dir), "THE ").select("id", "created_at")


@query(f"SELECT id, created_at FROM {_HISTORY} WHERE committed AND content_type = 'user'")
def history_by_type(spark, sf_dir):
    return history.by_type(history_rows(spark, sf_dir), "user").select("id", "created_at")


@query(f"SELECT id, committed FROM {_HISTORY} WHERE NOT committed OR id IN (SELECT id FROM {_HISTORY} WHERE committed ORDER BY created_at DESC, id DESC LIMIT 50)")
def history_prune(spark, sf_dir):
    return history.pruned(history_rows(spark, sf_dir)).select("id", "committed")


@query(f"SELECT id, content_type FROM (SELECT id, content_type, row_number() OVER (PARTITION BY content_type ORDER BY created_at DESC, id DESC) AS n FROM {_HISTORY}) WHERE n <= 50")
def history_prune_by_type(spark, sf_dir):
    return history.pruned_per(history_rows(spark, sf_dir), "content_type", 50).select("id", "content_type")


# ---- taps

TAP_WINDOW = 3_600_000
_GAPS = "SELECT user_id, event_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000 AS gap_ms FROM events"


@query(f"""WITH g AS ({_GAPS}), r AS (SELECT *, sum((gap_ms IS NULL OR gap_ms > {TAP_WINDOW})::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS pos FROM r), b AS (SELECT *, lag(pos) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ppos FROM p)
SELECT event_id, user_id, CASE WHEN pos % 2 = 0 THEN 'double' WHEN pos = 1 AND ppos % 2 = 1 AND gap_ms < {2 * TAP_WINDOW} THEN 'miss' ELSE 'first' END AS kind FROM b""")
def double_taps(spark, sf_dir):
    return taps.taps(table(spark, sf_dir, "events"), TAP_WINDOW).select("event_id", "user_id", "kind")


@query(f"WITH g AS ({_GAPS}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM g WHERE gap_ms IS NOT NULL) SELECT event_id, user_id, gap_ms FROM n WHERE n <= 100")
def last_100_gaps(spark, sf_dir):
    return taps.last_samples(taps.taps(table(spark, sf_dir, "events"))).select("event_id", "user_id", "gap_ms")


_ADAPTIVE = f"""WITH g AS ({_GAPS}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM g WHERE gap_ms IS NOT NULL),
a AS (SELECT user_id, count(*) AS n_samples, CASE WHEN count(*) < 10 THEN 0.0 ELSE list_sort(list(gap_ms))[(count(*) * 9 // 10 + 1)::INT] END AS window_ms FROM n WHERE n <= 100 GROUP BY user_id)"""


@query(_ADAPTIVE + " SELECT user_id, n_samples, window_ms FROM a")
def adaptive_threshold(spark, sf_dir):
    return taps.adaptive_windows(taps.last_samples(taps.taps(table(spark, sf_dir, "events"))))


@query(_ADAPTIVE + " SELECT user_id, coalesce(nullif(CASE WHEN user_id % 2 = 0 THEN window_ms ELSE 0 END, 0), CASE WHEN user_id % 3 = 0 THEN 300 END, 450)::DOUBLE AS window_ms FROM a")
def config_fallback_window(spark, sf_dir):
    own = taps.adaptive_windows(taps.last_samples(taps.taps(table(spark, sf_dir, "events"))))
    adaptive = F.when(F.col("user_id") % 2 == 0, F.col("window_ms")).otherwise(0)
    return own.select("user_id", taps.chosen_window(adaptive, F.when(F.col("user_id") % 3 == 0, 300.0)).cast("double").alias("window_ms"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_generation(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("generation"))
    return taps.latest(own, "user_id", "generation").select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def echo_guard(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return taps.without_echoes(own.select("event_id"), own.where("event_type = 'click'"), "event_id")


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) < 30 THEN 1.5 WHEN count(*) < 40 THEN 1.0 WHEN count(*) < 50 THEN 0.5 ELSE 0.0 END::DOUBLE AS seconds FROM events GROUP BY user_id")
def toast_decay(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("seconds", taps.toast_seconds(F.col("n")))


@query()
def document_tables(spark, sf_dir):
    """Formats and confidences of the tables found in documents as they are."""
    found = docs(spark, sf_dir).select(text.table_column(F.col("text")).alias("t"))
    return found.groupBy("t.format").agg(F.count("*").alias("n"), F.min("t.confidence").alias("least"), F.max("t.confidence").alias("most"))


# ---- the same operators over whole texts, into which the fragments are put; DuckDB can't follow

_LINES = "split(text, chr(10), -1)"
_IN_TSV = f"concat('number of the document', chr(9), 'its text', chr(10), array_join(transform({_LINES}, x -> concat(doc_id, chr(9), x)), chr(10)))"
_CELLS = f"array_join(transform({_LINES}, (x, i) -> concat('| ', i, ' | ', replace(x, '|', concat(chr(92), '|')), ' |')), chr(10))"
_IN_MD = f"concat('| line | text |', chr(10), '|:---|---:|', chr(10), {_CELLS})"
_OR_OWN = f"CASE WHEN contains(text, '|') THEN text ELSE {_IN_MD} END"
_WITH_COMMANDS = f"concat(text, chr(10), {DIRTY_COMMANDS})"
SECRET_AT_END = DIRTY_SECRET.replace("THEN concat('xo'", "THEN concat(text, ' xo'").replace("THEN concat('ey'", "THEN concat(text, ' ey'").replace("THEN repeat('Zz9+', 11)", "THEN concat(text, ' ', repeat('Zz9+', 11))").replace("THEN concat('-----BEGIN '", "THEN concat(text, chr(10), '-----BEGIN '").replace("THEN concat('s'", "THEN concat(text, ' s'")


@query()
def secret_pattern_whole(spark, sf_dir):
    return docs(spark, sf_dir, SECRET_AT_END).select("doc_id", native.secret_name(F.col("text")).alias("pattern"))


@query()
def json_pretty_whole(spark, sf_dir):
    own = docs(spark, sf_dir, "to_json(named_struct('text', text, 'lang', lang, 'a', array(doc_id, null)))").select("doc_id", "text")
    return cleaner.clean(own, names=["structural_detection"]).select("doc_id", "cleaned", "ctx.content_type")


@query()
def markdown_of_delimited_whole(spark, sf_dir):
    return cleaner.clean(docs(spark, sf_dir, _IN_TSV).select("doc_id", "text"), names=["structural_detection"]).select("doc_id", "cleaned")


@query()
def codespans_whole(spark, sf_dir):
    own = docs(spark, sf_dir, DIRTY_TOKENS).select("doc_id", "text")
    return cleaner.clean(own, config=Config(Settings(auto_wrapper=True)), names=["auto_wrapper"]).select("doc_id", "cleaned")


@query()
def table_rows_whole(spark, sf_dir):
    """The rows of documents that hold bars, and of a table of the lines of all others."""
    found = docs(spark, sf_dir, _OR_OWN).select("doc_id", text.table_column(F.col("text")).alias("t"))
    return found.select("doc_id", "t.format", "t.confidence", F.posexplode("t.rows").alias("row_no", "cells"))


@query()
def table_gate_whole(spark, sf_dir):
    """Every other table has no rule line."""
    own = docs(spark, sf_dir, f"CASE WHEN doc_id % 2 = 0 OR contains(text, '|') THEN {_OR_OWN} ELSE concat('line | text', chr(10), array_join(transform({_LINES}, (x, i) -> concat(i, ' | ', x)), chr(10))) END")
    found = own.select("doc_id", text.table_column(F.col("text")).alias("t")).select("doc_id", native.gated(F.col("t"), True, 0.8).alias("t"))
    return found.select("doc_id", "t.detected", F.array_join("t.warnings", "; ").alias("warning"), "t.rows")


@query()
def shell_commands_whole(spark, sf_dir):
    own = docs(spark, sf_dir, _WITH_COMMANDS).select("doc_id", F.posexplode(native.lines(F.col("text"))).alias("line_no", "line"))
    return own.select("doc_id", "line_no", native.is_shell_command(F.col("line")).alias("command"))


@query()
def wrapped_commands_whole(spark, sf_dir):
    return docs(spark, sf_dir, f"concat({_WITH_COMMANDS}, chr(10), '# note', chr(10), ' ls ')").select("doc_id", native.wrapped_commands(F.col("text")).alias("text"))


@query()
def collapsed_padding_whole(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id", F.posexplode(native.lines(F.col("text"))).alias("line_no", "line"))
    return own.select("doc_id", "line_no", native.collapsed_padding(F.expr("concat(repeat(' ', CAST(doc_id % 30 AS INT)), line, '    x   ')")).alias("line"))
