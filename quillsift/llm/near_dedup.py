"""MinHash near-duplicate detection with tensored banding.

Two collections A and B of `halves` base keys each (a base key hashes `rows` MinHash values) stand for halves**2 tables:
table (i, j) is keyed by the pair (A_i, B_j). Two sets of similarity s meet in some table unless no A_i or no B_j agrees,
so with 2 * halves * rows MinHash values the miss rate is at most 2 * (1 - s**rows)**halves: 5.2e-5 at s = 0.8 with 20
halves of 4 rows, 6.5e-5 at s = 0.85 with 14, where as many separate tables would take halves**2 * 2 * rows values.

1. A Python pass turns every whole text into its set's size, a 128-bit digest of the set, and its base keys.
2. Rows whose A keys nobody with another set shares go, then those whose B keys nobody shares: they can meet no one. What is left
   collapses to one numbered node a digest.
3. Diagonal tables (A_i, B_i) link each node to the most central node it meets; links are confirmed on full sets and contracted.
4. All tables are then built from the base keys that still hold nodes of different components. The nodes they leave open are
   compared by their rarest shingles, exactly (prefix and position filters): first by stars again, then all pairs of different
   components that pass the filters. No link between nodes that share a table is lost, and pairs already in one component are
   never emitted.

Nodes are 8-byte numbers between the steps; each table is deleted when the last step that reads it has run.

Nulls: a null text has an empty set. A null doc_id never becomes a component's smallest id unless it has no other.
Empty texts: an empty set (n_shingles 0), linked with nothing; its component_id is its own doc_id.
Ties and repeated rows: rows with one set share a component; all rows with the smallest doc_id are kept. one_of_each() keeps one of
them: the one whose text has the least MD5, and one of rows equal in id and text.
Very long texts: whole texts are read; a worker holds the shingles of 64 texts. Empty tables give no rows.
Extra columns are ignored by near_duplicates() and pass through one_of_each(), whose own columns take names that are free.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, free_names, map_batches, materialise, mix64, named, shingle_sets, text_bytes

#: Base keys a collection, and MinHash values a base key.
HALVES, ROWS = 20, 4
#: Tables of node numbers or pairs are broadcast up to this many rows (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_A, _B = (mix64(np.arange(at, at + 2 * 64 * 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1) for at in (1, 5000))


def base_keys(sets: list[np.ndarray], halves: int, rows: int) -> np.ndarray:
    """The 2 * halves base keys of each non-empty set, as int64; the number of the base key is part of it."""
    n = 2 * halves * rows
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), n), np.uint64)
    for k in range(n):
        least[:, k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), at)
    keys = np.zeros((len(sets), 2 * halves), np.uint64)
    for r in range(rows):
        keys = mix64(keys * np.uint64(31) + least[:, r::rows] + np.uint64(r + 1))
    return mix64(keys + np.arange(1, 2 * halves + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def digests(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits of each set, None for an empty one."""
    return [np.array([np.add.reduce(mix64(s + np.uint64(11))), np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + np.uint64(len(s))], dtype=np.uint64).tobytes() if len(s) else None for s in sets]


def few(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has no more than BROADCAST_IDS rows."""
    return F.broadcast(table) if table.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else table


def sketches(docs: DataFrame, words: int, halves: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (MD5 of the text), n_shingles, node (digest of the set), short (its first 8 bytes), and the base keys a and b."""

    def make():
        def work(batch):
            sets = shingle_sets(*text_bytes(batch.column("text")), words)
            some = [s for s in sets if len(s)]
            keys = iter(base_keys(some, halves, rows) if some else [])
            every = [next(keys) if len(s) else None for s in sets]
            names = digests(sets)
            short = [None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in names]
            return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "n_shingles": [len(s) for s in sets], "node": names, "short": short, "a": [None if k is None else k[:halves] for k in every], "b": [None if k is None else k[halves:] for k in every]}

        return work

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("mark"))
    return map_batches(own, "doc_id long, mark binary, n_shingles long, node binary, short long, a array<long>, b array<long>", make, rows=64)


def meeting(rows: DataFrame, side: str) -> DataFrame:
    """(row, keys): the rows that share a base key of this side with another set, and those keys."""
    keys = rows.select("row", "short", F.explode(side).alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo != hi").select("key"), f"shared_{side}")
    out = materialise(keys.select("row", "key").join(shared, "key").groupBy("row").agg(F.collect_list("key").alias("keys")), f"meeting_{side}")
    drop(shared)
    return out


def live_nodes(whole: DataFrame) -> DataFrame:
    """(nid, node, doc_id, n, a, b, own_a, own_b): one numbered row for each set that shares base keys of both sides with other sets; own_a and
    own_b are the keys that are shared."""
    filled = whole.where("node is not null")
    by_a = meeting(filled, "a")
    some = materialise(filled.join(few(by_a.select("row")), "row", "left_semi"), "some")
    by_b = meeting(some, "b")
    both = some.join(by_a.withColumnRenamed("keys", "own_a"), "row").join(by_b.withColumnRenamed("keys", "own_b"), "row")
    # equal digests have equal sets and keys: any row's will do, and the smallest id is looked up later
    one = both.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_shingles", "a", "b", "own_a", "own_b")])
    out = materialise(one.withColumnRenamed("n_shingles", "n").withColumn("nid", F.monotonically_increasing_id()), "live")
    drop(by_a, by_b, some)
    return out


def texts_of(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(nid, text) for the nodes, read from the documents that stand for them."""
    ids = nodes.select("doc_id").distinct()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = few(ids)
    chosen = own.join(wanted, own["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")

    def make():
        def work(batch):
            return {"node": digests(shingle_sets(*text_bytes(batch.column("text")), words)), "text": batch.column("text")}

        return work

    read = map_batches(chosen, "node binary, text string", make, rows=64)
    named = read.join(few(nodes.select("node", "nid")), "node").select("nid", "text")
    return materialise(named.groupBy("nid").agg(F.max("text").alias("text")), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Those (x, y) whose full sets are `percent` per cent alike at least: 100 * |both| >= percent * |either|. A written table; deletes
    the one of the pairs."""
    left, right = texts.select(F.col("nid").alias("x"), F.col("text").alias("tx")), texts.select(F.col("nid").alias("y"), F.col("text").alias("ty"))
    # a text moves to the nodes it is compared with: few of them, and only they, are looked for on the other side
    centres = right.join(few(pairs.select("y").distinct()), "y", "left_semi")
    both = left.join(few(pairs), "x").join(centres, "y").select("x", "y", "tx", "ty")

    def make():
        def work(batch):
            sx, sy = shingle_sets(*text_bytes(batch.column("tx")), words), shingle_sets(*text_bytes(batch.column("ty")), words)
            keep = []
            for a, b in zip(sx, sy, strict=True):
                common = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                keep.append(100 * common >= percent * (len(a) + len(b) - common) and common > 0)
            chosen = pa.array(keep)
            return {"x": batch.column("x").filter(chosen), "y": batch.column("y").filter(chosen)}

        return work

    out = materialise(map_batches(both, "x long, y long", make, rows=64), "links")
    drop(pairs)
    return out


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label), written, after joining the labels that links (x, y) connect; the smallest label stands for each component.
    Deletes the tables it is given.

    Each label hooks to its smallest neighbour, pointers are followed to their ends, and what is still linked hooks again."""
    edges = materialise(links.join(labels.withColumnsRenamed({"node": "x", "label": "lx"}), "x").join(labels.withColumnsRenamed({"node": "y", "label": "ly"}), "y").where("lx != ly").select(F.least("lx", "ly").alias("lx"), F.greatest("lx", "ly").alias("ly")).distinct(), "edges")
    drop(links)
    while not edges.isEmpty():
        up = materialise(edges.groupBy("ly").agg(F.min("lx").alias("top")).withColumnRenamed("ly", "label"), "up")
        while True:
            further = materialise(up.alias("u").join(up.select(F.col("label").alias("k"), F.col("top").alias("above")).alias("v"), F.col("top") == F.col("k"), "left").select("label", F.coalesce("above", "top").alias("top"), F.col("above").isNotNull().alias("moved")), "up")
            drop(up)
            up = further
            if further.where("moved").isEmpty():
                break
        named = materialise(labels.join(up.select("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        drop(labels)
        labels = named
        to = up.select(F.col("label").alias("k"), F.col("top").alias("to"))
        left = edges.join(to.withColumnsRenamed({"k": "lx", "to": "tx"}), "lx", "left").join(to.withColumnsRenamed({"k": "ly", "to": "ty"}), "ly", "left").select(F.coalesce("tx", "lx").alias("lx"), F.coalesce("ty", "ly").alias("ly")).where("lx != ly")
        left = materialise(left.select(F.least("lx", "ly").alias("lx"), F.greatest("lx", "ly").alias("ly")).distinct(), "edges")
        drop(edges, up)
        edges = left
    drop(edges)
    return labels


def components(docs: DataFrame, live: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, label) of the live nodes, by number: the smallest number stands for a component."""
    labels = materialise(live.select(F.col("nid").alias("node"), F.col("nid").alias("label")), "labels")
    if live.isEmpty():
        return labels
    texts = texts_of(docs, live.select("node", "nid", "doc_id"), words, id_col, text_col)

    # the diagonal tables: a star to the most central node that a node meets
    diagonal = materialise(live.select(F.col("nid").alias("node"), F.explode(F.zip_with("a", "b", lambda a, b: F.xxhash64(a, b))).alias("key")), "diagonal")
    labels = contract(labels, confirmed(stars(diagonal, labels), texts, percent, words))
    drop(diagonal)

    # what meets nodes of other components in any table
    met = slots(live, labels)
    mixed = materialise(met.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "mixed")
    open_nodes = materialise(met.join(mixed, "key", "left_semi").select("node").distinct(), "open")
    drop(met, mixed)
    if not open_nodes.isEmpty():
        rare = prefixes(texts, open_nodes, percent, words)
        labels = contract(labels, confirmed(stars(rare.select("node", "key"), labels), texts, percent, words))
        labels = contract(labels, confirmed(rest(rare, labels, percent), texts, percent, words))
        drop(rare)
    drop(texts, open_nodes)
    return labels


def near_duplicates(docs: DataFrame, *, percent: int = 80, words: int = 5, halves: int = HALVES, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, mark (MD5 of the text), n_shingles, node (digest of the set; null if empty), component_id, component
    (digest that stands for the component; null if the set is empty), kept."""
    sketched = materialise(sketches(docs, words, halves, rows, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    whole = materialise(sketched.select("doc_id", "mark", "n_shingles", "node"), "rows")
    live = live_nodes(sketched)
    drop(sketched)
    labels = components(docs, live, percent, words, id_col, text_col)
    moved = labels.where("node != label").join(live.select(F.col("nid").alias("node"), F.col("node").alias("own")), "node")
    moved = materialise(moved.join(live.select(F.col("nid").alias("label"), F.col("node").alias("component")), "label").select(F.col("own").alias("node"), "component"), "moved")
    drop(labels, live)
    filled = whole.where("node is not null").join(few(moved), "node", "left").withColumn("component", F.coalesce("component", "node"))
    filled = materialise(filled, "filled")
    least = materialise(filled.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    out = ("doc_id", "mark", "n_shingles", "node", "component_id", "component")
    empty = whole.where("node is null").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("binary")})
    return filled.join(least, "component").select(*out).unionByName(empty.select(*out)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component (of smallest id), and all rows with empty sets."""
    key, mark = free_names(docs, "key", "mark")
    found = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, **how), "found")
    first = found.where("kept and component is not null").groupBy("component").agg(F.first("doc_id").alias(key), F.min("mark").alias(mark)).select(key, mark)
    empty = found.where("component is null").select(F.col("doc_id").alias(key), F.col("mark").alias(mark))
    chosen = few(materialise(first.unionByName(empty).distinct(), "chosen"))
    twice = materialise(found.where("kept and component is not null").groupBy(F.col("doc_id").alias(key), F.col("mark").alias(mark)).agg(F.count("*").alias("c")).where("c > 1").select(key, mark), "twice")
    drop(found)
    own = docs.withColumns({key: F.col(id_col).cast("long"), mark: F.unhex(F.md5(F.col(text_col).cast("binary")))})
    on = lambda table: own[key].eqNullSafe(table[key]) & own[mark].eqNullSafe(table[mark])
    own = own.join(chosen, on(chosen), "left_semi")
    if not twice.isEmpty():  # of rows equal in id and text one stays; partial aggregation takes the others before the shuffle
        again = few(twice)
        own = own.join(again, on(again), "left_anti").unionByName(own.join(again, on(again), "left_semi").dropDuplicates([key, mark]))
    return own.select(*map(named, docs.columns))


def slots(live: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label): the tensored table keys made of shared base keys that hold more than one label. A written table."""
    side = lambda c, i: F.transform(c, lambda k: F.struct(F.lit(i).alias("side"), k.alias("key")))
    keys = live.select(F.col("nid").alias("node"), F.explode(F.concat(side("own_a", 0), side("own_b", 1))).alias("k")).select("node", "k.side", "k.key").join(labels, "node")
    keys = materialise(keys, "keys")
    mixed = materialise(keys.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "mixed")
    own = keys.join(mixed, "key").groupBy("node", "label").agg(F.collect_list(F.when(F.col("side") == 0, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("side") == 1, F.col("key"))).alias("b"))
    out = materialise(own.where("size(a) > 0 and size(b) > 0").select("node", "label", F.explode(F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: F.xxhash64(a, b))))).alias("key")), "slots")
    drop(keys, mixed)
    return out


def stars(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y), one pair a node at most: to the most central node (by the sizes of its buckets) of another label that is the most
    central one of a bucket of (node, key)."""
    sizes = materialise(buckets.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    inside = materialise(buckets.join(sizes, "key"), "inside")
    weights = materialise(inside.groupBy("node").agg(F.sum("c").alias("weight")).join(labels, "node"), "weights")
    ranked = materialise(inside.select("node", "key").join(weights, "node"), "ranked")
    drop(sizes, inside, weights)
    hubs = materialise(ranked.groupBy("key").agg(F.max(F.struct("weight", "node", "label")).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key", "hub"), "hubs")
    met = ranked.join(hubs, "key").where("label != hub.label")
    out = materialise(met.groupBy("node").agg(F.max("hub").alias("hub")).select(F.col("node").alias("x"), F.col("hub.node").alias("y")), "stars")
    drop(ranked, hubs)
    return out


def prefixes(texts: DataFrame, nodes: DataFrame, percent: int, words: int) -> DataFrame:
    """(node, n, key, i): the rarest shingles of each of the nodes, rarest first (i from 1), as many as two sets can do without and
    still be alike, and without those of one node alone. Alike sets share one of them. A written table.

    Shingles are read from the texts twice rather than written: once to count them, once to rank those that several nodes have."""
    own = texts.withColumnRenamed("nid", "node").join(few(nodes), "node", "left_semi")

    def make():
        def work(batch):
            sets = shingle_sets(*text_bytes(batch.column("text")), words)
            rows = np.repeat(np.arange(len(sets)), sizes := [len(s) for s in sets])
            return {"node": batch.column("node").take(pa.array(rows)), "n": np.repeat(sizes, sizes).astype(np.int32), "key": np.concatenate(sets).view(np.int64)}

        return work

    held = map_batches(own.select("node", "text"), "node long, n int, key long", make, rows=64)
    often = materialise(held.select("key").groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "often")
    # a node's own shingles come together, no more than its text has; those of one node alone come first: only their number matters
    placed = held.join(often, "key").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "key"))).alias("known"))
    first = placed.withColumn("alone", F.col("n") - F.size("known")).withColumn("known", F.slice("known", 1, F.greatest(F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1 - F.col("alone"), F.lit(0))))
    out = materialise(first.select("node", F.col("n").cast("long").alias("n"), "alone", F.posexplode("known").alias("at", "k")).select("node", "n", "k.key", (F.col("at") + 1 + F.col("alone")).cast("long").alias("i")), "prefixes")
    drop(often)
    return out


def rest(rare: DataFrame, labels: DataFrame, percent: int, needed: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """All pairs of different labels that share a rare shingle early enough in both orders, and have fitting sizes. needed: what sets
    of two sizes must share, by default for their union. A written table.

    Members of a shingle's largest label stand on one side only, so a bucket of one large component and a few strays costs
    strays times members. If the i-th and j-th shingles are the first in common, at most 1 + min(nx - i, ny - j) are. Sizes fall
    in fine classes, so a row only goes to classes for which its place is early enough."""
    t = percent / 100
    step = float(-np.log(t) / 8) if percent < 100 else 1.0
    at = rare.join(labels, "node")
    counts = at.groupBy("key", "label").agg(F.count("*").alias("c"))
    buckets = materialise(counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("most.label").alias("most")), "rare_buckets")
    within = materialise(at.join(buckets, "key").withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / step).cast("long")), "within")
    least = needed or (lambda a, b: F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent) - 1e-9))
    some = within.where("label != most").select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("label").alias("lx"), F.explode(F.sequence(F.col("size_class") - 9, F.col("size_class") + 9)).alias("size_class"))
    some = some.where(1 + F.col("nx") - F.col("ix") >= least(F.col("nx"), F.floor(F.exp(F.col("size_class") * step))))
    every = within.select("key", "size_class", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("i").alias("iy"), F.col("label").alias("ly"), (F.col("label") == F.col("most")).alias("in_most"))
    fits = (F.col("lx") != F.col("ly")) & (F.col("in_most") | (F.col("x") < F.col("y"))) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    early = 1 + F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= least(F.col("nx"), F.col("ny"))
    out = materialise(some.join(every, ["key", "size_class"]).where(fits & early).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "rest")
    drop(buckets, within)
    return out
