"""Tables that operators write for themselves: who owns them, and when they go."""

import gc
import os

from pyspark.sql import functions as F

from quillsift.llm import common, line_dedup, mixing, near_dedup

SF = "/root/testdata/sf0.001"


def folders(spark):
    base = f"{common.shared_dir(spark).removeprefix('file:')}/tables"
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def settle(spark):
    """The last plans that ran are known to be out of use once others ran."""
    for _ in range(3):
        spark.range(50).join(spark.range(5), "id").groupBy("id").count().collect()
        gc.collect()
        left = common.sweep(spark, now=True)
    return left


def test_nothing_is_left(spark):
    """What a query wrote is deleted once its result is out of use; a result that is read late still works."""
    settle(spark)
    before = folders(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    late = near_dedup.one_of_each(docs)
    sums = mixing.mix(docs).select("doc_id", "taken")
    lines = line_dedup.drop_repeated_lines(docs, group_mb=0).select("doc_id", "n_dropped")
    for _ in range(2):
        settle(spark)
        assert folders(spark) - before
        assert late.count() == len({r.doc_id for r in late.collect()}) and sums.agg(F.count("*")).first()[0] == lines.count() == 200
    del late, sums, lines
    settle(spark)
    assert not folders(spark) - before


def test_drop(spark):
    kept, gone = common.materialise(spark.range(5), "kept"), common.materialise(spark.range(5), "gone")
    common.drop(gone, spark.range(1), gone)
    assert kept.count() == 5 and not any(f.startswith("gone-") for f in folders(spark))


def test_free_names(spark):
    df = spark.range(1).withColumns({"Key": F.lit(1), "key_": F.lit(2)})
    assert common.free_names(df, "key", "id", "x", "x") == ["key__", "id_", "x", "x_"]
