"""Exact top-k by inner product: norm-sorted candidates, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors become whole numbers, floor(scale * x). The principal axes of all candidates (the eigenvectors of their d x d second moments,
summed by Spark; that is the right factor of their SVD) rotate them, so that the first coordinates hold most of an inner
product. Candidates are written in ranges of falling length, and a task takes its rows by falling length, block by block. For a
block, the partial sum over the first coordinates plus the product of the residual lengths bounds every inner product from above, and
only pairs whose bound reaches the query's floor get their exact product. The floor is the query's k-th score in the task so far, and
from the start its k-th score among the SEEDS longest candidates. A query is done with a whole task as soon as its length times the
next candidate's is below its floor. Tasks return k rows a query; a window merges them.

Queries come in blocks of at most `block` rows and BLOCK_MB; each is broadcast, run over all candidates in a job of its own, and
given back before the next, so memory and plan don't grow with the queries; no pairs are emitted. All rows of a block are
compared with a candidate once it is read, so that a pass is bound by arithmetic, not by reading.

Axes are made for the LENGTHS most frequent vector lengths of up to MOST_AXES components; others keep their own coordinates, for
which the bounds hold as well.

Nulls: rows with a null id or vector, or with null or non-finite components, take no part. Empty vectors score 0 with each
other. Vectors of different lengths have no score. Ties go to the smaller id. Repeated rows: a query's own id is left out, every
other row is a candidate of its own; equal queries are asked once. Empty tables give no rows. Extra columns are ignored; no name can clash.
Large components: whole numbers are kept as doubles, which hold them exactly, and pairs with a vector of length 2**31 or more are
multiplied as Python integers; ranks follow the exact scores, and a score beyond 64 bits is shown as the nearest 64-bit integer.
Very long vectors: a worker holds one Arrow batch of candidates and one block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialise, small_batches

#: Queries in a block and their MB, candidates that are bounded at once, pairs that are at most, and exact products that are made at once.
BLOCK, BLOCK_MB, STEP, PAIRS, PRODUCTS = 65_536, 64, 512, 1 << 18, 1 << 14
#: Candidates that give queries their first floor.
SEEDS = 1024
#: Vector lengths that get axes, and their most components.
LENGTHS, MOST_AXES = 8, 1024
#: Share of the squared length that the first coordinates are to hold on average.
HEAD = 0.6
#: Vectors shorter than this have products and sums below 2**62.
LARGE = 2.0**31
NONE = np.int64(-(2**63))


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double> of whole numbers), length: the rows that take part."""
    v = F.col(vector_col)
    floor = lambda y: F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  doubles beyond are whole
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: floor(x.cast("double") * scale)).alias("v"))
    return own.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def ragged(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: the places of the rows, and their matrix (float64)."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return {d: (rows := np.flatnonzero(sizes == d), flat[(at[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)) for d in np.unique(sizes).tolist()}


def moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By vector length: the sum of outer products over all rows that aren't large."""
    small = vectors.where(F.col("length") < LARGE)
    counts = small.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where(F.col("d").between(1, MOST_AXES))
    chosen = [r["d"] for r in counts.orderBy(F.desc("n"), "d").limit(LENGTHS).collect()]

    def part(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, (_, m) in ragged(b.column(0)).items():
                total[d] = total.get(d, 0) + m.T @ m
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(m.ravel())], names=["d", "at", "s"])

    out: dict[int, np.ndarray] = {}
    for r in small.where(F.size("v").isin(chosen)).select("v").mapInArrow(part, "d int, at int, s double").groupBy("d", "at").agg(F.sum("s").alias("s")).toLocalIterator():
        out.setdefault(r["d"], np.zeros(r["d"] * r["d"]))[r["at"]] = r["s"]
    return {d: m.reshape(d, d) for d, m in out.items()}


def axes(moment: np.ndarray) -> tuple[np.ndarray, int]:
    """Principal axes as columns, largest first, and how many make the head."""
    values, vectors = np.linalg.eigh(moment)
    values, vectors = np.maximum(values[::-1], 0), np.ascontiguousarray(vectors[:, ::-1])
    total = values.sum()
    return vectors, int(np.searchsorted(np.cumsum(values), HEAD * total) + 1) if total else 1


class Block:
    """The queries of one vector length in one block, with what the bounds need."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray | None = None, head: int = 0):
        self.ids, self.q, self.rotation = ids, q, rotation
        self.head = min(head, q.shape[1]) if rotation is not None else (q.shape[1] + 1) // 2
        r = self.turned(q)
        self.front, self.rest, self.length = r[:, : self.head], np.sqrt((r[:, self.head :] ** 2).sum(1)), np.sqrt((r**2).sum(1))
        self.floor = np.full(len(ids), -np.inf)

    def turned(self, v: np.ndarray) -> np.ndarray:
        return v if self.rotation is None else v @ self.rotation


class Best:
    """The best of a block's queries in a task: exact scores and ids, best first. Scores are int64, or Python integers once a large
    vector was met."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.s, self.i = np.full((len(block.ids), k), NONE), np.zeros((len(block.ids), k), np.int64)
        self.held, self.floor = np.zeros(len(block.ids), np.int64), block.floor.copy()
        self.live = np.arange(len(block.ids))
        self.made, self.step = 0, 32

    def offer(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Offers candidates, which fall in length from call to call."""
        block, r = self.block, self.block.turned(c)
        length = np.sqrt((r**2).sum(1))
        rest = np.sqrt((r[:, block.head :] ** 2).sum(1))
        to = 0
        while to < len(ids) and len(self.live):
            # short steps at first, while floors are low
            step = max(1, min(self.step, PAIRS // len(self.live)))
            at, to, self.step = to, min(to + step, len(ids)), min(2 * self.step, STEP)
            longest = length[at:to].max()
            slack = 1e-6 * (1 + block.length * longest)
            # queries that no candidate from here on can reach are done for good
            self.live = live = self.live[~(block.length[self.live] * longest + slack[self.live] < self.floor[self.live])]
            bound = block.front[live] @ r[at:to, : block.head].T + block.rest[live][:, None] * rest[at:to] + slack[live][:, None]
            qi, ci = np.nonzero(~(bound < self.floor[live][:, None]) & (block.ids[live][:, None] != ids[at:to]))
            if len(qi):
                self._exact(live[qi], at + ci, ids, c, length)

    def _exact(self, qi: np.ndarray, ci: np.ndarray, ids: np.ndarray, c: np.ndarray, length: np.ndarray) -> None:
        self.made += len(qi)
        q, k = self.block.q, self.k
        large = (length[ci] >= LARGE) | (self.block.length[qi] >= LARGE)
        if large.any() and self.s.dtype != object:
            self.s = self.s.astype(object)
        s = np.zeros(len(qi), self.s.dtype)
        plain = np.flatnonzero(~large)
        rows = np.unique(qi)
        first, last = int(ci.min()), int(ci.max()) + 1
        if 8 * len(qi) > len(rows) * (last - first) and self.block.length[rows].max() * length[first:last].max() < 2.0**52:
            # most pairs are wanted, and doubles hold every sum of their products exactly
            s[:] = (q[rows] @ c[first:last].T)[np.searchsorted(rows, qi), ci - first].astype(np.int64)
            plain = plain[:0]
        for at in range(0, len(plain), PRODUCTS):
            own = plain[at : at + PRODUCTS]
            s[own] = np.einsum("ij,ij->i", q[qi[own]].astype(np.int64), c[ci[own]].astype(np.int64))
        for x in np.flatnonzero(large).tolist():
            s[x] = sum(int(a) * int(b) for a, b in zip(q[qi[x]], c[ci[x]], strict=True))
        # the new ones beside the old ones, best k of each query
        all_s = np.concatenate([self.s[rows].ravel(), s])
        all_i = np.concatenate([self.i[rows].ravel(), ids[ci]])
        all_q = np.concatenate([np.repeat(np.arange(len(rows)), k), np.searchsorted(rows, qi)])
        there = np.concatenate([np.arange(k)[None, :].repeat(len(rows), 0).ravel() < self.held[rows].repeat(k), np.ones(len(s), bool)])
        all_s, all_i, all_q = all_s[there], all_i[there], all_q[there]
        o = np.lexsort((all_i, -all_s, all_q)) if all_s.dtype != object else np.array(sorted(range(len(all_s)), key=lambda x: (all_q[x], -all_s[x], all_i[x])))
        all_s, all_i, all_q = all_s[o], all_i[o], all_q[o]
        n = np.arange(len(o)) - np.searchsorted(all_q, all_q)
        top = n < k
        self.s[rows], self.i[rows] = NONE, 0
        self.s[rows[all_q[top]], n[top]], self.i[rows[all_q[top]], n[top]] = all_s[top], all_i[top]
        held = np.bincount(all_q[top], minlength=len(rows))
        self.held[rows] = held
        full = rows[held == k]
        last = self.s[full, k - 1].astype(np.float64)
        self.floor[full] = np.maximum(self.floor[full], last - 1e-9 * np.abs(last))

    def found(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Query places, ids and scores."""
        q, n = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        return q, self.i[q, n], [int(x) for x in self.s[q, n]]


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row that is_query (over the id as `id`) picks."""
    spark = vectors.sparkSession
    small_batches(spark)
    own = whole_numbers(vectors, scale, id_col, vector_col)
    every = materialise(own.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.desc("length"), F.col("id")), "vectors")
    rotations = {d: axes(m) for d, m in moments(every).items()}
    seeds = every.where(F.col("length") < LARGE).orderBy(F.desc("length"), "id").limit(SEEDS).toArrow()
    queries = materialise(every.where(is_query).select("id", "v").distinct(), "queries")  # a repeated query is asked once
    size = queries.agg(F.count("*").alias("n"), (F.sum(F.size("v") + 4) * 16 / 1e6).alias("mb")).first()
    blocks = max(1, -(-size["n"] // block), int(-(-(size["mb"] or 0) // BLOCK_MB)))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        part = queries.where(F.col("block") == b).orderBy("id", "v").toArrow()
        if not part.num_rows:
            continue
        ids = part.column("id").to_numpy()
        by_length = ragged(part.column("v").combine_chunks())
        held = {d: (rows, Block(ids[rows], m, *rotations.get(d, ()))) for d, (rows, m) in by_length.items()}
        for d, (rows, m) in (ragged(seeds.column("v").combine_chunks()) if seeds.num_rows else {}).items():
            if d in held:
                first = Best(held[d][1], k)
                first.offer(seeds.column("id").to_numpy()[rows], m)
                held[d][1].floor = first.floor
        sent = spark.sparkContext.broadcast((ids, held))

        def search(batches, sent=sent):
            ids, held = sent.value
            best = {d: Best(own, k) for d, (_, own) in held.items()}
            for batch in batches:
                if any(len(x.live) for x in best.values()):
                    own_ids = batch.column(0).to_numpy()
                    for d, (rows, m) in ragged(batch.column(1)).items():
                        if d in best:
                            best[d].offer(own_ids[rows], m)
            for d, x in best.items():
                q, i, s = x.found()
                places = held[d][0][q]
                yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(ids[places]), pa.array(i), pa.array([max(min(n, 2**63 - 1), -(2**63)) for n in s], pa.int64()), pa.array([_sortable(n) for n in s], pa.string())], names=["q", "query_id", "vec_id", "score", "exact"])

        found = every.select("id", "v", "length").sortWithinPartitions(F.desc("length")).select("id", "v").mapInArrow(search, "q int, query_id long, vec_id long, score long, exact string")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("exact"), "vec_id"))).where(F.col("rank") <= k)
        parts.append(materialise(ranked.select("query_id", "rank", "vec_id", "score"), "top"))
        sent.destroy()
    drop(every, queries)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for n, part in enumerate(parts):
        out = part if n == 0 else out.unionByName(part)
    return out


def _sortable(n: int) -> str | None:
    """Scores beyond 64 bits as texts that sort as they do; null for others, which `score` tells apart."""
    if -(2**63) < n < 2**63 - 1:
        return None
    shown = f"{abs(n):0400d}"
    return "1" + shown if n > 0 else "0" + shown.translate(str.maketrans("0123456789", "9876543210"))
