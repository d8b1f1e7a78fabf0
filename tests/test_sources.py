import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillsift.operators.rules import Rule
from quillsift.sources import config as C
from quillsift.sources import history as H
from quillsift.sources import text as T
from quillsift.streaming import taps


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[settings]\nauto_wrapper = true # on\n[settings.em_dash]\nreplace = ""\n[profiles.p]\nauto_wrapper = false\n[url_params]\nglobal_deny = ["q"]\n[exclusions]\nbundle_ids = ["x"]\n[[rules]]\nname = "r"\npattern = "a"\nreplacement = "b"\n')
    path.chmod(0o644)
    raw = C.load(path)
    c = C.resolve(raw)
    assert c.settings.auto_wrapper and c.settings.em_dash == "" and "q" in c.global_deny and c.rules == (Rule("r", "a", "b"),)
    assert not C.resolve(raw, "p").settings.auto_wrapper and C.resolve({}, "any").profile == "any"
    with pytest.raises(C.ConfigError):
        C.resolve(raw, "missing")
    assert C.problems(raw) == ["Bundle ID 'x' doesn't look like a valid bundle ID (missing '.')"]
    C.set_setting(path, "url_strip_scheme", True)
    C.set_setting(path, "auto_wrapper", False)
    again = C.resolve(C.load(path))
    assert again.settings.url_strip_scheme and not again.settings.auto_wrapper and again.rules and os.stat(path).st_mode & 0o777 == 0o600
    for value in ('a "quoted" one', "back\\slash", "line\nend\tand \x01", "plain"):
        C.set_setting(path, "note", value)
        assert C.load(path)["settings"]["note"] == value
    C.set_bool(path, "url_decode_pairs", True)
    C.set_string(path, "double_tap_window_ms", "auto")
    assert C.resolve(C.load(path)).settings.url_decode_pairs and C.resolve(C.load(path)).window_ms is None
    before = path.read_text()
    for call in (lambda: C.set_bool(path, "max_input_bytes", True), lambda: C.set_string(path, "double_tap_window_ms", "often"), lambda: C.set_bool(path, "none", True), lambda: C.set_setting(path, "a = 1\nb", 2)):
        with pytest.raises(C.ConfigError):
            call()
    assert path.read_text() == before
    path.chmod(0o666)
    with pytest.raises(C.ConfigIntegrityError):
        C.load(path)
    assert C.load(tmp_path / "none") == {} and C.resolve({"settings": {"double_tap_window_ms": "auto"}}).window_ms is None
    for bad in ({"double_tap_window_ms": 50}, {"table_cell_picker_min_confidence": 2.0}, {"max_input_bytes": 0}):
        with pytest.raises(C.ConfigError):
            C.resolve({"settings": bad})


def test_history(spark, tmp_path):
    folder = f"file://{tmp_path}/h"  # any folder that Spark can write
    h = H.History(spark, folder)
    df = spark.createDataFrame([(i, f"raw {i}", "100% A_b" if i == 7 else f"text {i}", "Prose", i // 2) for i in range(60)], "id long, raw string, cleaned string, kind string, created_at long")
    assert h.prepare(df, "b1", type_col="kind") and not h.prepare(df, "b1", type_col="kind")
    assert h.rows().where("committed").count() == 0
    h.rollback([59])
    h.rollback(F.col("id") == 59)  # by a condition; nothing is left of it
    h.commit(F.col("id") >= 0)
    rows = h.rows()
    assert rows.count() == 50 and [r.id for r in H.recent(rows, 3).collect()] == [58, 57, 56]
    assert H.search(rows, "a_B").count() == 0 and H.search(rows, "TEXT 1").count() == 10 and H.by_type(rows, "prose").count() == 0
    last = h.undo_last()
    assert (last.raw_text, last.cleaned_text, last.raw_hash) == ("raw 59", "text 59", hashlib.sha256(b"raw 59").hexdigest()) and len(json.loads(H.to_json(rows))) == 50
    assert H.recent(rows, 0).count() == H.search(rows, "text", -1).count() == 1
    h.prepare(df.limit(3), "b2")
    state = json.loads((tmp_path / "h" / "manifest.json").read_text())
    assert len(state["parts"]) == 2 and h.rows().count() == 53  # a part was added, nothing rewritten
    assert {r.content_type for r in h.rows().where("not committed").collect()} == {"Prose"}  # as classified
    assert H.History(spark, folder).rows().count() == 50
    found = {p.name for p in (tmp_path / "h").iterdir() if p.name.startswith("rows-")}
    assert found == set(json.loads((tmp_path / "h" / "manifest.json").read_text())["parts"]) and len(found) == 1
    (tmp_path / "h" / "manifest.json").write_text("{")
    (tmp_path / "h" / ".manifest.json.crc").unlink(missing_ok=True)
    assert H.History(spark, folder).rows().count() == 0 and (tmp_path / "h" / "manifest.json.corrupt").exists()


def test_taps(spark, tmp_path):
    ms = [0, 300, 600, 2000, 2500, 3400, 3600, 3800, 3900]
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate(ms)], "user_id long, event_id long, ms long").withColumn("ts", F.timestamp_millis(F.col("ms") + 1_700_000_000_000))
    kinds = [r.kind for r in taps.taps(df, 450).orderBy("event_id").collect()]
    assert kinds == ["first", "double", "first", "first", "miss", "first", "double", "first", "double"]
    df.select("user_id", "event_id", "ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = taps.stream_taps(stream, 450).writeStream.format("memory").queryName("taps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.kind for r in spark.table("taps").orderBy("event_id").collect()] == kinds
    w = taps.adaptive_windows(spark.createDataFrame([(1, float(x)) for x in range(10)] + [(2, 1.0)], "user_id long, gap_ms double"))
    assert {r.user_id: r.window_ms for r in w.collect()} == {1: 9.0, 2: 0.0}


def kinds_of(events, window):
    """(user, event) -> (gap, kind), by plain Python."""
    out, state = {}, {}
    for user, event, ms in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[2], e[1])):
        last, streak = state.get(user, (None, 0))
        gap = None if last is None else ms - last
        if gap is not None and gap <= window:
            streak += 1
            kind = "double" if streak % 2 == 0 else "first"
        else:
            kind = "miss" if gap is not None and streak % 2 == 1 and gap < 2 * window else "first"
            streak = 1
        state[user] = (ms, streak)
        out[user, event] = (gap, kind)
    return out


@pytest.mark.parametrize("range_ms", [700, 5_000, 10**9])
def test_taps_by_ranges(spark, range_ms):
    """A key's events are dealt by ranges of time, and runs go on over the borders; columns of any name stay."""
    r = random.Random(range_ms)
    events, ms = [], 0
    for i in range(600):
        ms += r.choice((0, 90, 300, 449, 450, 451, 800, 899, 900, 3000, 40_000))
        events.append((r.choice((1, 1, 1, 2, None)), i, ms))
    df = spark.createDataFrame(events, "user_id long, event_id long, ms long").withColumns({"ts": F.timestamp_millis(F.col("ms") + 1_700_000_000_000), **{c: F.lit("own") for c in ("part", "run", "us", "gap", "Kind", "carry", "first")}})
    out = taps.taps(df, 450, range_ms=range_ms)
    assert out.columns == ["user_id", "event_id", "ms", "ts", "part", "run", "us", "gap", "carry", "first", "gap_ms", "kind"]
    got = {(x.user_id, x.event_id): (x.gap_ms, x.kind) for x in out.collect()}
    assert got == kinds_of(events, 450) and len({k for _, k in got.values()}) == 3


def test_candidates_and_keys(spark):
    rows = [(1, 1, 0, "copy"), (1, 2, 500, "tap"), (1, 3, 900, "change"), (1, 4, 950, "tap"), (1, 5, 2000, "copy"), (1, 6, 3000, "tap"), (1, 7, 3001, "tap"), (2, 8, 3002, "tap")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ms long, what string").withColumn("ts", F.timestamp_millis("ms"))
    got = taps.with_candidates(df, F.col("what") == "copy", F.col("what") == "change").select("event_id", F.unix_millis("candidate").alias("c")).collect()
    assert {r.event_id: r.c for r in got} == {1: None, 2: 0, 3: 0, 4: None, 5: None, 6: 2000, 7: None, 8: None}
    keys = spark.createDataFrame([(8, True, False), (8, True, True), (7, True, False), (8, None, None), (None, True, False)], "k int, command boolean, paused boolean")
    assert [r[0] for r in keys.select(taps.is_tap(F.col("k"), command=F.col("command"), paused=F.col("paused"))).collect()] == [True, False, False, False, False]


def test_history_names(spark):
    df = spark.createDataFrame([(1, 5, "a", "x"), (2, 6, "a", "x"), (3, 7, "b", "x")], "id long, created_at long, g string, place string")
    assert sorted(tuple(r) for r in H.pruned_per(df, "g", 1).collect()) == [(2, 6, "a", "x"), (3, 7, "b", "x")]


def test_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("é\nb")
    assert T.read_texts(spark, str(tmp_path / "in")).first()["text"] == "é\nb"
    (tmp_path / "b.txt").write_bytes(b"\xff")
    with pytest.raises(Exception, match="UTF"):
        T.read_texts(spark, str(tmp_path / "b.txt")).collect()
    got = []
    T.sink(T.stream_texts(spark, str(tmp_path / "in")), lambda df, i: got.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert got == [2]
    back = []
    failing = T.sink(T.stream_texts(spark, str(tmp_path / "in")), lambda df, i: 1 // 0, str(tmp_path / "cp2"), lambda df, i: back.extend(r.text for r in df.collect()))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        failing.awaitTermination()
    assert sorted(back) == ["b", "é"]
    t = spark.createDataFrame([("| a | b |\n|---|---|\n| 1 | 2 |",), (None,)], "t string").select(T.table_column(F.col("t")).alias("t")).select("t.detected", T.table_json(F.col("t")).alias("j")).collect()
    assert [r.detected for r in t] == [True, False] and json.loads(t[0].j)["rows"] == [["a", "b"], ["1", "2"]]
