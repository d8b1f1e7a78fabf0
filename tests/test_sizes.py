"""What must hold for many texts at once."""

import pyarrow as pa
import pytest
from quillsift import registry
from quillsift.operators import tables
from quillsift.sources import text

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["table_aligned", "table_clipped", "table_delimited", "table_flattened", "table_markdown", "table_terminal"])
def test_texts_are_parsed_once(spark, name):
    """No filter that Spark infers from the rows' explosion parses each text once more, on as few cores as there are files."""
    assert registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("EvalPython [run(") == 1


def test_a_worker_holds_tables_of_few_texts(spark):
    texts = pa.array(["a\tb\nc\td", None, ""] * 100)
    parts = list(text.tables_of(texts))
    assert max(map(len, parts)) <= 64 and [r | {"confidence": round(r["confidence"], 2)} for r in pa.concat_arrays(parts).to_pylist()] == [vars(t := tables.extract_table(x or "")) | {"confidence": round(t.confidence, 2)} for x in texts.to_pylist()]
