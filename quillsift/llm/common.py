"""What the training-data operators share: shared-folder tables and ragged numpy views of text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.columns import free_names, named, plain  # noqa: F401  the operators take them from here

#: Rows that one step inside a Python worker handles at once; bounds a worker's memory beside one Arrow batch.
SLICE_ROWS, BATCH_ROWS = 256, 1024
#: The word pattern of every operator here, `[^\x20\x09-\x0D]+`, as a byte table of its separators.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or one of our own in local mode."""
    sc = spark.sparkContext
    if (found := sc.getCheckpointDir()) is None:
        if configured := spark.conf.get("spark.checkpoint.dir", None):
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillsift-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = sc.getCheckpointDir()
    return found


#: Tables that were written and not deleted yet: path to a weak reference of the JVM to the file index that every plan on it holds.
_LIVE: dict[str, object] = {}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors, and lets AQE split
    skewed joins on the result, as a table that was read has no partitioning of its own.

    The table goes with drop(), or some time after the last plan that reads it (see sweep()), or when Spark ends."""
    spark = df.sparkSession
    sweep(spark)
    base = f"{shared_dir(spark)}/tables"
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    jvm = spark._jvm
    _LIVE[path] = jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation().location())
    jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm.org.apache.hadoop.fs.Path(base))
    out._table = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _LIVE.pop(path, None)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that no later step reads."""
    for t in tables:
        if (path := getattr(t, "_table", None)) in _LIVE:
            _delete(t.sparkSession, path)


def sweep(spark: SparkSession, now: bool = False) -> int:
    """Deletes the tables that no plan can read any more, and returns how many are left. now: collects garbage first, so that
    plans that went out of use are known to have. (An RDD doesn't hold the plan it was made of: keep the DataFrame beside it.)"""
    if now:
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
    for path, held in list(_LIVE.items()):
        if held.get() is None:
            _delete(spark, path)
    return len(_LIVE)


def row_of(df: DataFrame) -> Column:
    """All columns of df as one struct, which no other name can clash with; `row.*` gives them back."""
    return F.struct(*map(named, df.columns))


def passing(df: DataFrame, columns: tuple[str, ...] | None, new: str) -> tuple[list[str], StructType]:
    """The columns of df (or those given) that pass an operator, and the schema of its result with the new columns after them. A
    column with the name of a new one, whatever the case, is replaced."""
    added = StructType.fromDDL(new)
    taken = {f.name.lower() for f in added}
    keep = [c for c in (df.columns if columns is None else columns) if c.lower() not in taken]
    return keep, StructType([*(df.schema[c] for c in keep), *added])


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = SLICE_ROWS) -> DataFrame:
    """df.mapInArrow over slices of at most `rows` rows. make() runs once a task and returns the function of a slice, which
    returns columns by name."""
    out = pa_schema(df.sparkSession, schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                got = work(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([c if isinstance(c := got[f.name], pa.Array) else pa.array(c, type=f.type) for f in out], schema=out)
        del work
        give_back()

    return plain(df).mapInArrow(run, schema)


def give_back() -> None:
    """Returns memory that this worker has freed to the machine: it stays, idle, beside the workers of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed blocks otherwise
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most in this session: texts are long, and idle workers keep what they once needed."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pa_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other, and the offsets of the texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_starts(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the first bytes of the words of ragged texts, and which bytes are between words."""
    space = IS_SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]
    start[first] = ~space[first]
    return np.flatnonzero(start), space


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z lower-cased words of ragged texts, and for each text the index of its first word (one more at the end)."""
    at, space = word_starts(raw, offs)
    bounds = np.searchsorted(at, offs)
    if not len(at):
        return np.empty(0, np.uint64), bounds
    place = np.arange(len(raw))
    place[at[0] :] -= np.repeat(at, np.diff(np.append(at, len(raw))))
    place[space] = 0
    place = np.maximum(place, 0)
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, dtype=np.uint64))
    part = (LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers[place]
    part[space] = 0
    return mix64(np.add.reduceat(part, at)), bounds


def shingle_sets(raw: np.ndarray, offs: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `words` words; of the whole sequence if it has fewer; none without words."""
    hashes, bounds = word_hashes(raw, offs)
    salts = mix64(np.arange(1, words + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        total = np.zeros(n, np.uint64)
        for j in range(words):
            total += hashes[j : j + n] * salts[j]
        rolled = mix64(total)
    else:
        rolled = np.empty(0, np.uint64)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = hi - lo
        if n >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif n:
            out.append(mix64(np.array([np.add.reduce(hashes[lo:hi] * salts[:n]) + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def native_word_count(text: str):
    """The number of `[^\\x20\\x09-\\x0D]+` in a text column, 0 for null, by built-in functions alone."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class IntTable:
    """Places of distinct 64-bit keys by vectorised lookup: one place a key in a power-of-two table, the crowded rest sorted."""

    def __init__(self, keys: np.ndarray, bits: int = 19):
        self.bits = bits
        place = self._place(keys)
        first = np.unique(place, return_index=True)[1]
        self.keys, self.at = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int64)
        self.keys[place[first]], self.at[place[first]] = keys[first], first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest], kind="stable")]
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[place[rest]] = True
        self.more, self.more_at = keys[rest], rest

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 if it isn't there."""
        place = self._place(keys)
        out = np.where(self.keys[place] == keys, self.at[place], -1)
        if len(self.more) and len(odd := np.flatnonzero(self.crowded[place] & (out < 0))):
            at = np.minimum(np.searchsorted(self.more, keys[odd]), len(self.more) - 1)
            out[odd] = np.where(self.more[at] == keys[odd], self.more_at[at], -1)
        return out
