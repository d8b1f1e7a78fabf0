"""Queries over configurations, the history's steps, and the events around taps, and the same in DuckDB SQL."""

from __future__ import annotations

import dataclasses
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.chars import EXCLUDED_APPS, TRACKING
from ..operators import cleaner
from ..sources import config as C
from ..sources import history
from ..streaming import taps
from .queries import _HISTORY, docs, history_rows, parted, q, query, table

# ---- configuration

RAW = {
    "settings": {"auto_wrapper": True, "max_input_bytes": 5000, "em_dash": {"replace": "-"}, "double_tap_window_ms": "auto"},
    "profiles": {"plain": {"auto_wrapper": False, "url_cleaning": False}, "code": {"whitespace_cleanup": False, "max_input_bytes": 1}},
    "url_params": {"global_deny": ["ref"]}, "exclusions": {"bundle_ids": ["org.example.own"]},
}
_DEFAULTS = ", ".join(f"('{f.name}', '{str(f.default).lower()}')" for f in dataclasses.fields(C.Settings))


@query(f"""WITH defaults(name, value) AS (VALUES {_DEFAULTS}), profiles(profile) AS (VALUES (NULL), ('plain'), ('code')),
own(name, value) AS (VALUES ('auto_wrapper', 'true'), ('max_input_bytes', '5000'), ('em_dash', '-'), ('double_tap_window_ms', 'auto')),
laid(profile, name, value) AS (VALUES ('plain', 'auto_wrapper', 'false'), ('plain', 'url_cleaning', 'false'), ('code', 'whitespace_cleanup', 'false'))
SELECT p.profile, d.name, coalesce(l.value, o.value, d.value) AS value FROM defaults d CROSS JOIN profiles p LEFT JOIN own o USING (name) LEFT JOIN laid l ON l.profile = p.profile AND l.name = d.name
UNION ALL SELECT profile, 'deny', unnest([{', '.join(map(q, (*TRACKING, 'ref')))}]) FROM profiles UNION ALL SELECT profile, 'excluded', unnest([{', '.join(map(q, (*EXCLUDED_APPS, 'org.example.own')))}]) FROM profiles""")
def config_resolution(spark: SparkSession, sf_dir: str):
    """Settings under each profile: defaults, the file's own, and what a profile may set of them; lists are appended."""
    rows = []
    for profile in (None, "plain", "code"):
        found = C.resolve(RAW, profile)
        rows += [(profile, name, str(value).lower()) for name, value in dataclasses.asdict(found.settings).items()]
        rows += [(profile, "deny", x) for x in found.global_deny] + [(profile, "excluded", x) for x in found.excluded_apps]
    return spark.createDataFrame(rows, "profile string, name string, value string")


@query("""SELECT unnest(['Too many user rules: 51 (max 50)', 'max_input_bytes must be > 0', 'table_cell_picker_min_confidence must be between 0.0 and 1.0', 'double_tap_window_ms must be between 100 and 2000',
  'Profile name cannot be empty', 'Bundle ID ''x'' doesn''t look like a valid bundle ID (missing ''.'')']) AS problem""")
def config_problems(spark: SparkSession, sf_dir: str):
    """What validation says about a configuration with one fault of each kind."""
    rules = [{"name": f"r{i}", "pattern": "a", "replacement": "b"} for i in range(51)]
    raw = {"rules": rules, "settings": {"max_input_bytes": 0, "table_cell_picker_min_confidence": 1.5, "double_tap_window_ms": 50}, "profiles": {"": {}}, "exclusions": {"bundle_ids": ["x", "a.b"]}}
    return spark.createDataFrame([(p,) for p in C.problems(raw)], "problem string")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(t, chr(8212), '--') ELSE t END AS cleaned FROM (SELECT doc_id, concat(replace(replace(text, chr(8212), ' '), '’', ''), ' {chr(8212)} x') AS t FROM documents WHERE text IS NOT NULL)")
def feature_switch(spark: SparkSession, sf_dir: str):
    """Whole texts under two profiles: one has the Unicode stage off, and its texts stay as they are."""
    raw = {"settings": {"sensitive_filter": False}, "profiles": {"raw": {"normalize_unicode": False}}}
    own = docs(spark, sf_dir, f"concat(replace(replace(text, '{chr(8212)}', ' '), '’', ''), ' {chr(8212)} x')").where("text is not null").select("doc_id", "text")
    on, off = (cleaner.clean(own.where(f"doc_id % 2 = {n}"), config=C.resolve(raw, p), names=["normalize_unicode"]) for n, p in ((0, None), (1, "raw")))
    return on.unionByName(off).select("doc_id", "cleaned")


# ---- history


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below the checkpoint directory, or a temporary one in local mode."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillsift-")
    return f"{base}/history-{uuid.uuid4().hex}"


_ALL = f"(SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM {_HISTORY} WHERE id % 5 <> 0)"


@query(f"SELECT id, true AS committed, 'first' AS step FROM {_ALL} WHERE n <= 50 UNION ALL SELECT id, false, 'second' FROM {_HISTORY} WHERE id % 5 = 0 UNION ALL SELECT id, true, 'second' FROM {_ALL} WHERE n <= 50")
def history_steps(spark: SparkSession, sf_dir: str):
    """Prepared, rolled back, replayed and committed batches: the committed rows are pruned to the newest, others wait."""
    folder = shared_folder(spark)
    rows = history_rows(spark, sf_dir).select("id", "raw_text", "cleaned_text", "content_type", "created_at")
    how = {"raw_col": "raw_text", "cleaned_col": "cleaned_text", "type_col": "content_type"}
    h = history.History(spark, folder)
    h.prepare(rows.where("id % 5 <> 0"), "one", **how)
    h.prepare(rows.where("id % 5 = 0"), "gone", **how)
    h.rollback(F.col("id") % 5 == 0)
    h.commit()
    h.prepare(rows, "one", **how)  # a replay
    kept = [(r["id"], r["committed"], "first") for r in h.rows().select("id", "committed").limit(history.KEEP + 1).collect()]
    h.prepare(rows.where("id % 5 = 0"), "two", **how)
    h.fs.deleteOnExit(h._path(""))
    return spark.createDataFrame(kept, "id long, committed boolean, step string").unionByName(h.rows().select("id", "committed", F.lit("second").alias("step")))


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'Url' ELSE 'Json' END AS content_type FROM documents")
def history_types(spark: SparkSession, sf_dir: str):
    """The types that preparing gives cleaned texts."""
    made = "CASE doc_id % 2 WHEN 0 THEN concat('https://example.com/', doc_id) ELSE to_json(named_struct('text', coalesce(text, ''))) END"
    rows = history.prepared(docs(spark, sf_dir, made), id_col="doc_id", raw_col="text", cleaned_col="text", created_col="doc_id")
    return rows.select(F.col("id").alias("doc_id"), "content_type")


# ---- events around taps

_KEYS = "event_id % 3 = 0 AS c, event_id % 7 <> 1 AS command, event_id % 11 = 2 AS control, event_id % 13 = 3 AS alternate, event_id % 5 = 4 AS repeated, user_id % 4 = 3 AS paused"


@query(f"SELECT event_id FROM (SELECT event_id, {_KEYS} FROM events) WHERE c AND command AND NOT control AND NOT alternate AND NOT repeated AND NOT paused")
def key_events(spark: SparkSession, sf_dir: str):
    """Events that count as taps, by the key and the flags that their ids stand for."""
    e, u = F.col("event_id"), F.col("user_id")
    fits = taps.is_tap(F.when(e % 3 == 0, taps.TAP_KEY).otherwise(0), command=e % 7 != 1, control=e % 11 == 2, alternate=e % 13 == 3, repeated=e % 5 == 4, paused=u % 4 == 3)
    return parted(table(spark, sf_dir, "events")).where(fits).select("event_id")


CANDIDATE_MS = 7_200_000


@query(f"""WITH e AS (SELECT event_id, user_id, ts, event_id % 3 = 0 AS made, event_id % 4 = 1 AS changed FROM events),
w AS (SELECT *, max(CASE WHEN made THEN (ts, event_id) END) OVER o AS m, max(CASE WHEN changed AND NOT made THEN (ts, event_id) END) OVER o AS c FROM e
  WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(m[1]) <= {CANDIDATE_MS}::BIGINT * 1000 AND (c IS NULL OR c < m) THEN epoch_us(m[1]) END AS candidate FROM w""")
def pending_candidates(spark: SparkSession, sf_dir: str):
    """The candidate that is still pending at each event: not too old, and nothing changed since."""
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = taps.with_candidates(own, F.col("event_id") % 3 == 0, F.col("event_id") % 4 == 1, ttl_ms=CANDIDATE_MS)
    return found.select("event_id", F.unix_micros(F.col("candidate").cast("timestamp")).alias("candidate"))
