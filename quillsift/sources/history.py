"""History of cleaned texts: Parquet parts in a folder that driver and executors share, any that Spark can write, and queries on them.

A manifest lists the parts that count and the batches that were added; a change writes its part first, then publishes a new manifest by a rename, so
readers see the one or the other. Preparing adds a part of rows with committed = false; a batch is added once by its id, so a
replayed batch changes nothing. Committing and rolling back compact all parts into one; parts that no manifest names are deleted.
Ties of created_at are broken by id, newest first.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import native
from ..functions.columns import free_names
from ..operators.classify import classify

DDL = "id bigint, raw_hash string, raw_text string, cleaned_text string, content_type string, preview string, committed boolean, created_at bigint"
KEEP, UNDO = 50, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@pandas_udf(StringType())
def content_type(text: pd.Series) -> pd.Series:
    """What each text is; null for null."""
    return text.map(lambda t: None if t is None else classify(t))


def prepared(df: DataFrame, *, id_col: str = "id", raw_col: str = "raw", cleaned_col: str = "cleaned", type_col: str | None = None, created_col: str = "created_at", store_raw: bool = False) -> DataFrame:
    """Rows of the history table for raw and cleaned texts, not yet committed. Without type_col cleaned texts are classified."""
    return df.select(
        F.col(id_col).cast("bigint").alias("id"), F.sha2(raw_col, 256).alias("raw_hash"), (F.col(raw_col) if store_raw else F.lit(None).cast("string")).alias("raw_text"), F.col(cleaned_col).alias("cleaned_text"),
        (F.col(type_col) if type_col else content_type(F.col(cleaned_col))).alias("content_type"), native.preview(F.col(cleaned_col)).alias("preview"), F.lit(False).alias("committed"), F.col(created_col).cast("bigint").alias("created_at"),
    )


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def _limit(n: int) -> int:
    """At least one row."""
    return max(1, n)


def recent(history: DataFrame, n: int) -> DataFrame:
    return history.where("committed").orderBy(*newest_first()).limit(_limit(n))


def search(history: DataFrame, query: str, n: int | None = None) -> DataFrame:
    """Rows whose cleaned text holds query literally, A-Z as a-z."""
    found = history.where(F.col("committed") & F.contains(F.translate("cleaned_text", _UPPER, _LOWER), F.lit(query.translate(str.maketrans(_UPPER, _LOWER)))))
    return found.orderBy(*newest_first()).limit(_limit(n)) if n is not None else found


def by_type(history: DataFrame, content_type: str, n: int | None = None) -> DataFrame:
    found = history.where(F.col("committed") & (F.col("content_type") == content_type))
    return found.orderBy(*newest_first()).limit(_limit(n)) if n is not None else found


def pruned(history: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest committed rows, and all that aren't committed. TakeOrdered keeps `keep` rows a task, so nothing gathers."""
    return history.where("committed").orderBy(*newest_first()).limit(keep).unionByName(history.where("not committed"))


def pruned_per(history: DataFrame, group: str, keep: int) -> DataFrame:
    """The newest rows of each group; Spark cuts each task's rows to `keep` a group before the shuffle."""
    (place,) = free_names(history, "place")
    return history.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(*newest_first()))).where(F.col(place) <= keep).drop(place)


def to_json(history: DataFrame, n: int = KEEP) -> str:
    """The n newest rows as a JSON array."""
    rows = recent(history, n).select("id", "preview", "cleaned_text", "raw_text", "content_type", "created_at").collect()
    return json.dumps([r.asDict() for r in rows], ensure_ascii=False)


class Undo(NamedTuple):
    raw_text: str
    cleaned_text: str
    raw_hash: str


class History:
    """A history in a folder that driver and executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.undo = spark, folder.rstrip("/"), deque(maxlen=UNDO)
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}")
        self.fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path(self.folder))
        state = self._state()
        if state is None:  # unreadable: set aside, and start anew
            self.fs.delete(self._path("manifest.json.corrupt"), False)
            self.fs.rename(self._path("manifest.json"), self._path("manifest.json.corrupt"))
        elif state["parts"]:
            self._compact(self.rows().where("committed"), state["batches"])  # what was never committed goes

    def _state(self) -> dict | None:
        if not self.fs.exists(self._path("manifest.json")):
            return {"parts": [], "batches": []}
        stream = self.fs.open(self._path("manifest.json"))
        try:
            state = json.loads(bytes(stream.readAllBytes()))
            return state if {"parts", "batches"} <= state.keys() else None
        except (ValueError, AttributeError):
            return None
        finally:
            stream.close()

    def rows(self) -> DataFrame:
        parts = (self._state() or {"parts": []})["parts"]
        return self.spark.read.schema(DDL).parquet(*[f"{self.folder}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], DDL)

    def _write(self, rows: DataFrame) -> str:
        part = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return part

    def _publish(self, parts: list[str], batches: list[str]) -> None:
        beside, place = self._path("manifest.json.tmp"), self._path("manifest.json")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(json.dumps({"parts": parts, "batches": batches[-1000:]}).encode()))
        stream.hsync()
        stream.close()
        self.fs.setPermission(beside, self.spark._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        # a rename that replaces, where the store has one
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(place), over)
        for found in self.fs.listStatus(self._path("")):
            name = found.getPath().getName()
            if name.startswith("rows-") and name not in parts:
                self.fs.delete(found.getPath(), True)

    def _compact(self, rows: DataFrame, batches: list[str]) -> None:
        self._publish([self._write(rows.coalesce(1) if rows.limit(KEEP + 1).count() <= KEEP else rows)], batches)

    def prepare(self, df: DataFrame, batch: str, *, raw_col: str = "raw", **how) -> bool:
        """Adds rows that aren't committed; False if the batch was added before."""
        state = self._state() or {"parts": [], "batches": []}
        if batch in state["batches"]:
            return False
        part = self._write(prepared(df, raw_col=raw_col, **how))
        self._publish([*state["parts"], part], [*state["batches"], batch])
        new = df.select(F.col(raw_col).alias("raw_text"), F.col(how.get("cleaned_col", "cleaned")).alias("cleaned_text"), F.sha2(raw_col, 256).alias("raw_hash"), F.col(how.get("created_col", "created_at")).alias("created_at"), F.col(how.get("id_col", "id")).alias("id"))
        self.undo.extend(Undo(r["raw_text"], r["cleaned_text"], r["raw_hash"]) for r in new.orderBy(*newest_first()).limit(UNDO).collect()[::-1])
        return True

    @staticmethod
    def _chosen(ids: list[int] | Column) -> Column:
        return ids if isinstance(ids, Column) else F.col("id").isin(ids)

    def commit(self, ids: list[int] | Column | None = None, keep: int = KEEP) -> None:
        """Commits the rows that a list of ids or a condition picks, all without one."""
        chosen = F.lit(True) if ids is None else self._chosen(ids)
        self._compact(pruned(self.rows().withColumn("committed", F.col("committed") | chosen), keep), self._state()["batches"])

    def rollback(self, ids: list[int] | Column) -> None:
        """Takes back rows that aren't committed, by a list of ids or a condition."""
        self._compact(self.rows().where(F.col("committed") | ~self._chosen(ids)), self._state()["batches"])

    def undo_last(self) -> Undo | None:
        """The newest text that was prepared, raw and cleaned, even if it was rolled back."""
        return self.undo.pop() if self.undo else None

    def write_batch(self, df: DataFrame, batch_id: int, **how) -> None:
        """For foreachBatch: a batch that is replayed changes nothing."""
        if self.prepare(df, f"stream-{batch_id}", **how):
            self.commit()
