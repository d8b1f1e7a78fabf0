"""Where texts come from and go to: files of whole texts, HTML, streams of text files, JSON and plain columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import TABLE_DDL, extract_table

_STRINGS = pa.list_(pa.field("element", pa.string()))
#: TABLE_DDL as Arrow has it.
TABLE_TYPE = pa.struct([("detected", pa.bool_()), ("format", pa.string()), ("confidence", pa.float32()), ("rows", pa.list_(pa.field("element", _STRINGS))), ("warnings", _STRINGS)])
#: Texts of which a worker holds the tables at once.
STEP_ROWS = 64


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, text. Files that aren't UTF-8 are an error."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.expr("validate_utf8(cast(content AS string))").alias("text"))


def stream_texts(spark: SparkSession, path: str) -> DataFrame:
    """New lines of the text files that arrive in a folder."""
    return spark.readStream.format("text").load(path).withColumnRenamed("value", "text")


def write_texts(df: DataFrame, path: str, text_col: str = "cleaned") -> None:
    """The plain text alone, one file of lines a partition."""
    df.select(F.col(text_col)).write.text(path)


def sink(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, restore: Callable[[DataFrame, int], None] | None = None):
    """A stream to each(batch, batch_id); what each does must stand a replay of the last batch. If it fails, restore(batch, batch_id) puts
    back what was there (the raw texts), and the failure goes on."""

    def guarded(batch: DataFrame, batch_id: int) -> None:
        try:
            each(batch, batch_id)
        except Exception:
            if restore is not None:
                restore(batch, batch_id)
            raise

    return stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def html_column(html: Column) -> Column:
    """The text of HTML, with code-styled runs in backticks."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(s):
        from ..operators.richtext import rich_text

        return s.map(rich_text)

    return run(html)


def candidate_column(html: Column, plain: Column) -> Column:
    """The better of the rich and the plain form of one text; null if there is neither."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(rich, own):
        import pandas as pd

        from ..operators.richtext import better_text, rich_text

        return pd.Series([better_text(rich_text(h), p) for h, p in zip(rich, own, strict=True)], dtype=object)

    return run(html, plain)


def tables_of(texts: pa.Array) -> Iterator[pa.Array]:
    """The tables (TABLE_DDL) of STEP_ROWS texts after the other."""
    for at in range(0, len(texts), STEP_ROWS):
        found = [extract_table(t or "") for t in texts.slice(at, STEP_ROWS).to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([getattr(t, f.name) for t in found], f.type) for f in TABLE_TYPE], fields=list(TABLE_TYPE))


def table_column(text: Column) -> Column:
    """The table of a text (TABLE_DDL). A worker holds the tables of STEP_ROWS texts as objects, and gives them on before the next."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(TABLE_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from tables_of(batch)

    return run.asNondeterministic()(text)  # so that no filter that Spark infers parses the texts once more


def table_json(table: Column) -> Column:
    return F.to_json(table)
