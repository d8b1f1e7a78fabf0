"""Mixing sources to target weights by weighted fair queueing, with built-in functions only.

Targets: a budget (`share` of all sizes) goes to the sources by weight; a source stops at `most` times its own size and its
excess is shared again by weight. Sorted by size over weight, the sources that stop are a prefix, so running sums find it.

Queue: documents are shuffled by a hash of id and text; a copy's virtual finish time is what its source has handed out up to
and including it, in each round of `most` rounds, divided by the source's target weight. Copies are taken in
order of finish time until the budget is full. The running sum of a source is cut at ranges of the shuffle key (a sum for
each range first, then within the range), so a source with a third of all rows is no hot key. All copies that finish by 1
fit in the budget by construction; those after are sorted by range of finish time to fill what rounding to whole documents left.

Rows that are equal in id, source and text (MD5) stand in the queue as one with their number, in portions of PORTION at most, so that a row
repeated without end is no hot key either; each portion takes as many turns as it has rows.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is shuffled like any value.
Empty texts: taken when their finish time is, with 0 words. A source of size 0 has target 0 and none is taken.
Ties and repeated rows: rows that are equal in id, source and text are interchangeable, so it doesn't matter which of them is taken once more;
the digest of the result is the same in each run. Very long texts: only sizes and hashes move. Empty tables give no rows.
Extra columns aren't carried by mix(); mixed_rows() carries them, as one struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise, native_word_count, row_of

#: Ranges of the shuffle key a source, in shuffle partitions.
RANGES_A_PARTITION = 4
#: Equal rows that stand in the queue as one, at most.
PORTION = 10_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes: source, source_size. Adds weight and target. One row a source, sorted in one task: sources are few next to documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = weighed.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    full = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    left = lambda win: F.col("budget") - F.coalesce(F.sum("cap").over(win), F.lit(0.0))
    pull = lambda win: F.col("all_weight") - F.coalesce(F.sum("weight").over(win), F.lit(0.0))
    # a source stops if its cap is no more than its part of what the ones that stop before it leave
    w = w.withColumn("stops", F.col("cap") * pull(before) <= left(before) * F.col("weight"))
    w = w.withColumn("level", F.first(F.when(~F.col("stops"), F.try_divide(left(before), pull(before))), ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return w.select("source", "source_size", "weight", F.when(F.col("stops"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, mark (MD5 of the text), size, spot (the shuffle key), portion and rows (how many equal rows stand in it)."""
    text = F.col(text_col)
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.unhex(F.md5(text.cast("binary"))).alias("mark"), native_word_count(text_col).alias("size"), F.xxhash64(F.lit("shuffle"), F.col(id_col), text).alias("spot"))
    equal = one.groupBy("doc_id", "source", "mark", "size", "spot").agg(F.count("*").alias("every"))
    dealt = equal.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("every") - 1) / PORTION))))
    return dealt.withColumn("rows", F.least(F.lit(PORTION), F.col("every") - F.col("portion") * PORTION)).drop("every")


def running(df: DataFrame, group: list[str], range_of: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the running sum of value in the order of (range_of, order) within group: range sums first, then within a range."""
    g = [f"_g{i}" for i in range(len(group))]
    df = df.withColumns({**{own: F.col(c) for own, c in zip(g, group, strict=True)}, "_r": range_of})
    sums = df.groupBy(*g, "_r").agg(F.sum(value).alias("_s"))
    ahead = Window.partitionBy(*g).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialise(sums.withColumn("_before", F.coalesce(F.sum("_s").over(ahead), F.lit(0))).drop("_s"), "ranges")
    on = df["_r"].eqNullSafe(sums["_r"])
    for c in g:
        on = on & df[c].eqNullSafe(sums[c])
    joined = df.join(sums, on, "left").select(*[df[c] for c in df.columns], sums["_before"])
    own = Window.partitionBy(*g, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn(name, F.col("_before") + F.sum(value).over(own)).drop("_before", "_r", *g)


def portions(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """sized() with source_size, target, and turns: how often the rows of the portion are taken, together. A written table."""
    if most != int(most) or most < 1:
        raise ValueError("most must be a whole number: documents are taken whole")
    spark = docs.sparkSession
    rows = materialise(sized(docs, id_col, text_col, source_col).withColumn("words", F.col("size") * F.col("rows")), "sized")
    per_source = materialise(targets(rows.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    ranges = RANGES_A_PARTITION * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    range_of = F.floor((F.shiftrightunsigned("spot", 1) / F.lit(2.0**63)) * ranges).cast("long")
    # spot alone may tie by chance; what follows it makes the order whole
    order = [F.shiftrightunsigned("spot", 1), F.col("spot"), F.col("doc_id"), F.col("mark"), F.col("portion")]
    queued = running(rows, ["source"], range_of, order, "words", "run")
    t = per_source.withColumnRenamed("source", "_source")
    queued = materialise(queued.join(t, queued["source"].eqNullSafe(t["_source"]), "left").drop("_source", "weight"), "queued")
    drop(rows)

    finish = lambda e: F.try_divide(F.lit(float(e)) * F.col("source_size") + F.col("run"), F.col("target"))

    def turns(cut: Column) -> Column:
        """A portion that finishes by cut is taken whole in that round; of others those rows that finish by 1."""
        taken = F.lit(0).cast("long")
        for e in range(int(most)):
            part = F.floor(F.try_divide(F.col("target") - F.lit(float(e)) * F.col("source_size") - F.col("run") + F.col("words"), F.col("size")))
            taken = taken + F.when(finish(e) <= cut, F.col("rows")).otherwise(F.greatest(F.lit(0), F.least(F.col("rows") - 1, F.coalesce(part, F.lit(0))))).cast("long")
        return F.when(F.col("target") > 0, taken).otherwise(F.lit(0).cast("long"))

    # what whole documents left of the budget goes to the next copies in order of finish time
    used = queued.agg(F.sum(turns(F.lit(1.0)) * F.col("size")).alias("used")).first()["used"] or 0
    budget = per_source.agg(F.sum("target").alias("b")).first()["b"] or 0.0
    late = queued.where("size > 0").select("doc_id", "mark", "portion", "spot", "words", F.explode(F.array(*[finish(e) for e in range(int(most))])).alias("finish")).where("finish > 1")
    late_range = F.floor(F.log2("finish") * ranges).cast("long")
    sums = late.groupBy(late_range.alias("r")).agg(F.sum("words").alias("s"))
    ahead = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    last = sums.withColumn("b", F.coalesce(F.sum("s").over(ahead), F.lit(0))).where(F.col("b") + F.lit(used) <= F.lit(budget)).agg(F.max("r").alias("r")).first()["r"]
    cut = 1.0
    if last is not None:
        near = running(late.where(late_range <= last), [], late_range, [F.col("finish"), F.col("spot"), F.col("doc_id"), F.col("mark"), F.col("portion")], "words", "run")
        over = near.agg(F.min(F.when(F.col("run") + F.lit(used) > F.lit(budget), F.col("finish"))).alias("over"), F.max("finish").alias("all")).first()
        # strictly before the first portion that doesn't fit: copies with one finish time stay together
        cut = near.where(F.col("finish") < over["over"]).agg(F.max("finish").alias("c")).first()["c"] or 1.0 if over["over"] is not None else over["all"]
    out = materialise(queued.select("doc_id", "source", "mark", "portion", "spot", "size", "rows", "source_size", "target", turns(F.lit(cut)).alias("turns")), "turns")
    drop(queued, per_source)
    return out


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (words), copies."""
    every = portions(docs, weights, share, most, id_col, text_col, source_col)
    several = every.where("rows > 1").repartition("spot", "portion")  # portions of one row part ways before they grow to rows
    place = several.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    place = place.withColumn("turns", F.floor(F.col("turns") / F.col("rows")) + F.when(F.col("place") <= F.col("turns") % F.col("rows"), 1).otherwise(0)).select(every.columns)
    out = every.where("rows = 1").unionByName(place)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("turns") * F.col("size")).cast("long").alias("taken"), F.col("turns").cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs with each row as often as it is taken."""
    every = portions(docs, weights, share, most, id_col, text_col, source_col)
    key = ["id", "src", "mark"]
    per = every.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("src"), "mark").agg(F.sum("turns").alias("turns"), F.sum("rows").alias("rows")).where("turns > 0")
    per = materialise(per.select(*key, F.floor(F.col("turns") / F.col("rows")).alias("each"), (F.col("turns") % F.col("rows")).alias("more")), "taken")
    drop(every)
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("mark"), row_of(docs).alias("row"))

    def met(some: DataFrame) -> DataFrame:
        on = own["id"].eqNullSafe(some["id"]) & own["src"].eqNullSafe(some["src"]) & own["mark"].eqNullSafe(some["mark"])
        return own.join(some, on).select(*[own[c] for c in own.columns], "each", "more")

    out = met(per.where("more = 0")).select("row", F.col("each").alias("times"))
    if not (uneven := per.where("more > 0")).isEmpty():  # equal rows, of which the queue took some once more: those that stand first as written
        written = materialise(met(uneven), "uneven").select("*", "_metadata.file_name", "_metadata.row_index", F.lit(1).cast("long").alias("one"))
        ranked = running(written, key, F.col("file_name"), [F.col("row_index")], "one", "place")
        out = out.unionByName(ranked.select("row", (F.col("each") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)).alias("times")))
    again = out.where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return again.select("row.*")
