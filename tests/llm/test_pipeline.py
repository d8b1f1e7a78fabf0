"""The pipeline's stages, each against a plain version of its own input, and the whole run."""

import random
from collections import Counter

import pytest
import test_near_dedup as N
import test_operators as T
from pyspark.sql import functions as F

from quillsift.llm import language_id, line_dedup, segment_sampling
import corpus_pipeline as c

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Whole documents with nulls, empty and very long texts, repeated rows, near copies, and columns with the operators' own names."""
    own = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    first = own.orderBy("doc_id").first()
    r = random.Random(2)
    long = " ".join(r.choice(first.text.split()) for _ in range(30_000))
    odd = [(9000, None, "en", "s", 0), (9001, "", None, None, 0), (9002, "123", "en", "s", 3), (9003, first.text, "en", "s", 1), (9003, first.text, "en", "s", 1), (9004, first.text + " and more", None, "s", 1), (9005, long, "en", "t", 5), (None, None, None, None, None)]
    df = own.unionByName(spark.createDataFrame(odd, own.schema))
    clash = {x: F.lit(f"own {x}") for x in ("score", "lang_pred", "kept_text", "n_lines", "mark", "component", "spot", "row", "key", "samples", "copies")}
    return df.withColumns(clash)


def rows(df):
    return [r.asDict() for r in df.collect()]


def same(got, exp):
    key = lambda d: tuple(sorted((k, repr(v)) for k, v in d.items()))
    return Counter(map(key, got)) == Counter(map(key, exp))


def test_language(spark, docs):
    got = c.identify_language(spark, docs, SF)
    model = language_id.learn(docs.where(~language_id.held_out("doc_id")))
    exp = [d for d in rows(docs) if (f := model.infer(d["text"]))[0] != "und" and f[2][0][1] >= c.MAIN_LANGUAGE]
    assert got.columns == docs.columns and same(rows(got), exp) and 90 < len(exp) < docs.count()


def test_lines(spark, docs):
    got = c.drop_lines(spark, docs, SF)
    hold, exp = {}, []
    least = -(2**63)
    for n, d in enumerate(rows(docs)):
        for k in {line_dedup.line_key(x) for x in (d["text"] or "").split("\n")}:
            hold.setdefault(k, {})[n] = least if d["doc_id"] is None else d["doc_id"]
    for d in rows(docs):
        lines = (d["text"] or "").split("\n")
        kept = [x for x in lines if not (len(k := line_dedup.line_key(x)) >= 20 and len(hold[k]) >= 3 and max(hold[k].values()) != (least if d["doc_id"] is None else d["doc_id"]))]
        text = None if d["text"] is None else "\n".join(kept)
        exp.append(d | {"text": text, "n_chars": len(text) if len(kept) < len(lines) else d["n_chars"]})
    assert got.columns == docs.columns and same(rows(got), exp)


def test_near_duplicates(spark, docs):
    got = rows(c.drop_near_duplicates(spark, docs, SF))
    own = rows(docs)
    comp = {(d, n): least for d, n, least in N.brute([(d["doc_id"], d["text"]) for d in own], 80)}
    empty = [d for d in own if not N.shingles(d["text"])]
    assert same([d for d in got if not N.shingles(d["text"])], empty)
    kept = [d for d in got if N.shingles(d["text"])]
    assert sorted(d["doc_id"] for d in kept) == sorted({least for (_, n), least in comp.items() if n}) and len(kept) < len(own) - len(empty)
    assert all(d in own for d in kept)


def test_mix(spark, docs):
    got, own = rows(c.mix_sources(spark, docs, SF)), rows(docs.distinct())
    spots = {(r[0], r[1]): r[2] for r in docs.select("doc_id", "text", F.xxhash64(F.lit("shuffle"), "doc_id", "text")).collect()}
    every = rows(docs)
    exp, _ = T.queue([(d["doc_id"], d["text"], d["source"], spots[d["doc_id"], d["text"]]) for d in every], (5, 2, 1), 1.5, 2)
    copies = Counter()
    for i, d in enumerate(every):
        copies[d["doc_id"]] += exp[i] if d["text"] else 0
    assert Counter(d["doc_id"] for d in got if d["text"]) == +copies and all(d in own for d in got)


def test_segments(spark, docs):
    got = {r.doc_id: r for r in c.sample_segmentations(spark, docs, SF).collect()}
    lat = segment_sampling.lattice_of(T.P.path("piece_bpe_32k.model"), 1.0)
    for d in rows(docs):
        r = got[d["doc_id"]]
        assert r.n_samples == len(r.ids) == len(r.logp) == (0 if not d["text"] else r.n_samples) and all(r.decoded) and r.source == d["source"]
        assert all(lat.decode(i) == d["text"] for i in r.ids) and len({tuple(i) for i in r.ids}) == len(r.ids)


def test_run(spark, docs):
    """Every stage works on what the one before kept, and stands an empty table."""
    at = docs
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns
        at = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < at.count()
    assert c.STAGES[-1][1](spark, at, SF).count() == at.count()
    for _, stage in c.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    whole = c.run(spark, SF)
    assert whole.count() > 100 and all(all(r.decoded) for r in whole.collect())
