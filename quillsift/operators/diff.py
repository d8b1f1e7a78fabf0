"""A line diff of a text before and after, as rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.columns import free_names, named, plain

#: Pairs of equal lines that a diff looks at, at most; texts with more, which repeat a few lines over and over, are shown as replaced between
#: their common beginning and end.
MOST_PAIRS = 4_000_000
#: Rows that one step inside a worker holds.
STEP_ROWS = 256


def line_diff(before: str, after: str) -> Iterator[tuple[str, str]]:
    """(sign, line): `-` gone, `+` new, blank in both; nothing if the texts are equal."""
    if before == after:
        return
    a, b = before.split("\n"), after.split("\n")
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]), strict=False)) if x != y), min(len(a), len(b)) - head)
    yield from ((" ", line) for line in a[:head])
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    often = Counter(y)
    if sum(n * often[line] for line, n in Counter(x).items()) > MOST_PAIRS:
        steps = [("replace", 0, len(x), 0, len(y))]
    else:
        steps = SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    for tag, i, j, k, m in steps:
        if tag == "equal":
            yield from ((" ", line) for line in x[i:j])
        else:
            yield from (("-", line) for line in x[i:j])
            yield from (("+", line) for line in y[k:m])
    yield from ((" ", line) for line in a[len(a) - tail :])


def diff_rows(df: DataFrame, before: str, after: str, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns with line_no (from 1), sign and line of each row's diff; rows with a null text have none. One Arrow pass."""
    names = free_names(df, "before", "after")
    schema = StructType([*(df.schema[c] for c in keep), StructField("line_no", IntegerType()), StructField("sign", StringType()), StructField("line", StringType())])
    out, n = to_arrow_schema(schema), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                rows, numbers, signs, lines = [], [], [], []
                for i, (x, y) in enumerate(zip(part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True)):
                    if x is not None and y is not None:
                        found = list(line_diff(x, y))
                        rows += [i] * len(found)
                        numbers += range(1, len(found) + 1)
                        signs += [s for s, _ in found]
                        lines += [line for _, line in found]
                at_row = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at_row) for i in range(n)), pa.array(numbers, pa.int32()), pa.array(signs, pa.string()), pa.array(lines, pa.string())], schema=out)

    return plain(df.select(*map(named, keep), F.col(before).alias(names[0]), F.col(after).alias(names[1]))).mapInArrow(run, schema)
