"""Line deduplication against sharded minimal perfect hashes.

1. A Python pass turns every whole text into the 128-bit hashes of its distinct long lines. Spark counts the documents of each
   hash and the largest doc_id that holds it, with partial aggregation, so a line of a third of all documents is no hot key.
2. The hashes that two documents hold at least are dealt to shards by their first half; for each shard a minimal perfect hash
   (levels of bit vectors: a level seats the keys that hash to a place alone, the rest go on) indexes compact arrays of
   fingerprints, counts and largest ids. Lines of one document can't be dropped, so they need no place: their fingerprint won't match.
3. Documents probe the arrays, and drop a line if its count is `min_docs` at least and the largest id another one. Up to `group_mb` of
   shards are broadcast, and one pass over the documents probes them all. A larger index stays where it is: the hashes of long lines go
   to their shard, a crowded shard in several parts, and what each part finds goes back to the documents. Either way the
   documents are read once, whatever the size of the index, and a worker holds one shard or one broadcast.

Nulls and empty texts: one empty line, never dropped. A null doc_id counts as smaller than any other.
Ties and repeated rows: each row counts as a document; all rows with the largest doc_id keep the line, with all its repeats.
Very long texts: whole texts. Empty tables give no rows. Other columns pass through; one with the name of a new column is replaced.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, free_names, map_batches, materialise, mix64, named, pa_schema, passing

#: Keys that a shard holds about, MB of index that are broadcast at most, and lines that one part of a shard is asked for at most, about.
SHARD_KEYS, GROUP_MB, PART_LINES = 50_000, 64, 500_000
STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
_NO_ID = -(2**63)


def line_key(line: str) -> str:
    return line.strip(STRIP).translate(_LOWER)


def key_hashes(keys: list[str]) -> np.ndarray:
    """(n, 2) uint64."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys), dtype=">u8").astype(np.uint64).reshape(-1, 2)


# ---- one shard: a minimal perfect hash with its arrays, as bytes


def _places(h1: np.ndarray, h2: np.ndarray, level: int, m: int) -> np.ndarray:
    """Where a level of m bits seats the keys; both halves count, so that keys with one first half part ways."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (((mix64(h1 + salt) + mix64(h2 ^ salt)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)


def build_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> bytes:
    """The pairs (h1, h2) must be distinct; h2 is kept as the fingerprint."""
    levels, order, left = [], [], np.arange(len(h1))
    while len(left):
        m = max(64, int(len(left) * 1.7) // 64 * 64)
        at = _places(h1[left], h2[left], len(levels), m).astype(np.int64)
        alone = np.bincount(at, minlength=m)[at] == 1
        bits = np.zeros(m, np.uint8)
        bits[at[alone]] = 1
        levels.append(np.packbits(bits, bitorder="little").tobytes())
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    seats = np.concatenate(order) if order else np.empty(0, np.int64)
    head = struct.pack(f"<II{len(levels)}I", len(h1), len(levels), *(len(x) for x in levels))
    return head + b"".join(levels) + h2[seats].astype("<u8").tobytes() + counts[seats].astype("<u4").tobytes() + largest[seats].astype("<i8").tobytes()


class Shard:
    """The arrays of a shard as they lie in the blob; a level's rank is kept once in 64 bits."""

    def __init__(self, blob: bytes):
        n, k = struct.unpack_from("<II", blob)
        sizes, at = struct.unpack_from(f"<{k}I", blob, 8), 8 + 4 * k
        self.levels, seated = [], 0
        for s in sizes:
            words = np.frombuffer(blob, "<u8", s // 8, at)
            before = seated + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, before[:-1].astype(np.uint32)))
            seated, at = int(before[-1]), at + s
        self.prints = np.frombuffer(blob, "<u8", n, at)
        self.counts = np.frombuffer(blob, "<u4", n, at + 8 * n)
        self.largest = np.frombuffer(blob, "<i8", n, at + 12 * n)

    def seat(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The index of each key, -1 if it isn't in the shard."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (words, before) in enumerate(self.levels):
            at = _places(h1[left], h2[left], level, 64 * len(words))
            word, bit = words[at >> np.uint64(6)], at & np.uint64(63)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = before[at[hit] >> np.uint64(6)] + below
            left = left[~hit]
        found = out >= 0
        found[found] = self.prints[out[found]] == h2[found]
        return np.where(found, out, -1)

    def goes(self, h1: np.ndarray, h2: np.ndarray, mine: np.ndarray, min_docs: int) -> np.ndarray:
        """Which lines go: min_docs documents hold them at least, and another than `mine` has the largest id."""
        seat = self.seat(h1, h2)
        at = np.maximum(seat, 0)
        return (seat >= 0) & (self.counts[at] >= min_docs) & (self.largest[at] != mine) if len(self.prints) else np.zeros(len(h1), bool)


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1 >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


# ---- over the corpus


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, doc_id) of each row's distinct keys of at least min_chars code points."""

    def make():
        def work(batch):
            ids, hashes = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                keys = {k for line in (text or "").split("\n") if len(line) >= min_chars and len(k := line_key(line)) >= min_chars}
                if keys:
                    ids += [_NO_ID if doc_id is None else doc_id] * len(keys)
                    hashes.append(key_hashes(list(keys)))
            both = np.concatenate(hashes).view(np.int64) if hashes else np.empty((0, 2), np.int64)
            return {"h1": both[:, 0], "h2": both[:, 1], "doc_id": ids}

        return work

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "h1 long, h2 long, doc_id long", make)


def line_index(docs: DataFrame, *, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """A table (shard, blob) of the lines that two documents hold at least, and the number of shards."""
    repeated = materialise(line_hashes(docs, min_chars, id_col, text_col).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest")).where("n > 1"), "lines")
    shards = max(1, -(-repeated.count() // shard_keys))

    def shard_col(batches):
        for b in batches:
            s = shard_of(b.column("h1").to_numpy().view(np.uint64), shards).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(s), *b.columns], names=["shard", *b.schema.names])

    def build(table: pa.Table) -> pa.Table:
        h1, h2, n, largest = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "largest"))
        h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "blob": pa.array([build_shard(h1, h2, np.minimum(n, 2**32 - 1), largest)], pa.binary())})

    dealt = repeated.mapInArrow(shard_col, "shard int, h1 long, h2 long, n long, largest long")
    out = materialise(dealt.groupBy("shard").applyInArrow(build, "shard int, blob binary"), "shards")
    drop(repeated)
    return out, shards


def long_lines(text: str | None, min_chars: int) -> tuple[list[str], list[int], list[str]]:
    """The lines of a text, and the places and keys of those that are long enough."""
    lines, places, keys = (text or "").split("\n"), [], []
    for j, line in enumerate(lines):
        if len(line) >= min_chars and len(k := line_key(line)) >= min_chars:
            places.append(j)
            keys.append(k)
    return lines, places, keys


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS, group_mb: float = GROUP_MB, part_lines: int = PART_LINES) -> DataFrame:
    """docs with kept_text (the lines that stay, joined by newlines), n_lines (before) and n_dropped."""
    index, shards = line_index(docs, min_chars=min_chars, id_col=id_col, text_col=text_col, shard_keys=shard_keys)
    mb = (index.agg(F.sum(F.length("blob"))).first()[0] or 0) / 1e6
    if mb <= group_mb:
        return probed(docs, index, shards, min_chars, min_docs, id_col, text_col)
    return joined(docs, index, shards, min_chars, min_docs, id_col, text_col, part_lines)


NEW = "kept_text string, n_lines long, n_dropped long"


def probed(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """One pass over the documents against the whole index, which is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in index.toLocalIterator()])
    drop(index)
    keep, schema = passing(docs, None, NEW)
    chosen = docs.select(*map(named, keep), F.col(id_col).cast("long").alias(free_names(docs, "id")[0]), F.col(text_col).alias(free_names(docs, "text")[0]))

    def make():
        own_index = {s: Shard(b) for s, b in held.value}

        def work(batch):
            ids = batch.column(len(keep)).to_pylist()
            split = [long_lines(t, min_chars) for t in batch.column(len(keep) + 1).to_pylist()]
            doc = np.repeat(np.arange(len(split)), [len(p) for _, p, _ in split])
            gone = np.zeros(len(doc), bool)
            if len(doc):
                h = key_hashes([k for _, _, keys in split for k in keys])
                mine = np.array([_NO_ID if i is None else i for i in ids], np.int64)[doc]
                shard = shard_of(h[:, 0], shards)
                for s in np.unique(shard).tolist():
                    if s in own_index:
                        own = np.flatnonzero(shard == s)
                        gone[own] = own_index[s].goes(h[own, 0], h[own, 1], mine[own], min_docs)
            place = np.array([j for _, p, _ in split for j in p], np.int64)
            drops = np.split(place[gone], np.searchsorted(doc[gone], np.arange(1, len(split))))
            return dict(zip(keep, batch.columns)) | kept_of([lines for lines, _, _ in split], [d.tolist() for d in drops])

        return work

    return map_batches(chosen, schema, make)


def kept_of(lines: list[list[str]], drops: list[list[int]]) -> dict:
    kept = []
    for own, d in zip(lines, drops, strict=True):
        gone = set(d)
        kept.append("\n".join([x for j, x in enumerate(own) if j not in gone] if gone else own))
    return {"kept_text": kept, "n_lines": [len(x) for x in lines], "n_dropped": [len(d) for d in drops]}


def joined(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int, id_col: str, text_col: str, part_lines: int) -> DataFrame:
    """The hashes of long lines go to the shards' parts; the places of lines to drop come back by id and MD5 of the text."""
    mark_of = F.unhex(F.md5(F.col(text_col).cast("binary")))

    def ask():
        def work(batch):
            rows, places, keys = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                _, p, k = long_lines(t, min_chars)
                rows += [i] * len(p)
                places += p
                keys += k
            h = key_hashes(keys)
            rows = pa.array(rows, pa.int32())
            return {"id": batch.column("id").take(rows), "mark": batch.column("mark").take(rows), "line": places, "h1": h[:, 0].view(np.int64), "h2": h[:, 1].view(np.int64), "shard": shard_of(h[:, 0], shards).astype(np.int32)}

        return work

    asked = docs.select(F.col(id_col).cast("long").alias("id"), mark_of.alias("mark"), F.col(text_col).alias("text"))
    # equal rows ask once; a line that a third of the documents hold makes its shard crowded, and many parts of it
    asked = materialise(map_batches(asked, "id long, mark binary, line int, h1 long, h2 long, shard int", ask), "asked")
    parts = materialise(asked.groupBy("shard").agg(F.ceil(F.count("*") / part_lines).cast("int").alias("parts")), "parts")
    dealt = asked.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("id", "mark", "line"), F.col("parts")).cast("int")).drop("parts")
    blobs = index.join(F.broadcast(parts), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "blob")
    found = pa_schema(docs.sparkSession, "id long, mark binary, line int")

    def probe(lines: pa.Table, blob: pa.Table) -> pa.Table:
        if not lines.num_rows or not blob.num_rows:
            return found.empty_table()
        h1, h2 = (lines.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        mine = lines.column("id").fill_null(_NO_ID).to_numpy()
        gone = Shard(blob.column("blob")[0].as_py()).goes(h1, h2, mine, min_docs)
        return lines.select(["id", "mark", "line"]).filter(pa.array(gone)).cast(found)

    gone = dealt.groupBy("shard", "part").cogroup(blobs.groupBy("shard", "part")).applyInArrow(probe, "id long, mark binary, line int")
    drops = materialise(gone.groupBy("id", "mark").agg(F.collect_set("line").alias("lines")), "drops")
    drop(asked, parts, index)
    keep, schema = passing(docs, None, NEW)
    own = docs.select(F.struct(*map(named, keep)).alias("row"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("key"), mark_of.alias("own_mark"))
    met = own.join(drops, own["key"].eqNullSafe(drops["id"]) & own["own_mark"].eqNullSafe(drops["mark"]), "left")
    text, lines = free_names(docs, "text", "lines")
    met = met.select(*[F.col("row")[c].alias(c) for c in keep], F.col("text").alias(text), F.col("lines").alias(lines))

    def make():
        def work(batch):
            split = [(t or "").split("\n") for t in batch.column(len(keep)).to_pylist()]
            return dict(zip(keep, batch.columns)) | kept_of(split, [x or [] for x in batch.column(len(keep) + 1).to_pylist()])

        return work

    return map_batches(met, schema, make)
