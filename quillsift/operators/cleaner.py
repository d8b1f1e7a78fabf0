"""The cleaner: guards, classification and the stages in their order, over a text or a DataFrame column.

Over a DataFrame the guards are native columns; rows that they skip come back as they were. The stages run fused in one Arrow pass, so a
row crosses to Python and back once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import native
from ..functions.chars import n_bytes
from ..functions.columns import free_names, named, plain
from ..sources.config import Config
from .base import CONTEXT_DDL, Context, Stage, summary
from .characters import artifact_stage, secret_in, unicode_stage
from .classify import classify
from .codespans import codespan_stage
from .layout import layout_stage
from .links import link_stage
from .rules import rule_stage
from .structure import structure_stage

#: Output of a stage beyond so many times the input's bytes takes everything back.
MOST_EXPANSION = 2.0
#: Rows that one step inside a worker holds.
STEP_ROWS = 512
#: Stages of others: name to stage; they run after the built-in ones, in order of registration.
REGISTERED: dict[str, Stage] = {}


def register_stage(name: str, stage: Stage) -> None:
    REGISTERED[name] = stage


def stages_of(config: Config, names: list[str] | None = None) -> list[tuple[str, Stage]]:
    """The enabled stages in order; names (a selection) can leave out, but not reorder."""
    s = config.settings
    every: list[tuple[str, bool, Stage]] = [
        ("normalize_unicode", s.normalize_unicode, unicode_stage(s.em_dash)),
        ("whitespace_cleanup", s.whitespace_cleanup, layout_stage),
        ("agent_strip", s.agent_strip, artifact_stage),
        ("structural_detection", s.structural_detection, structure_stage),
        ("url_cleaning", s.url_cleaning, link_stage(strip_scheme=s.url_strip_scheme, decode_pairs=s.url_decode_pairs, deny=config.global_deny, domains=config.domains)),
        ("auto_wrapper", s.auto_wrapper, codespan_stage),
        ("user_rules", s.user_rules and bool(config.rules), rule_stage(list(config.rules))),
        *((name, True, stage) for name, stage in REGISTERED.items()),
    ]
    return [(name, stage) for name, on, stage in every if on and (names is None or name in names)]


def run_stages(text: str, stages: list[tuple[str, Stage]], ctx: Context) -> str:
    """Classifies the text as it came, then runs the stages; too much expansion after any of them returns the text unchanged."""
    ctx.content_type = classify(text)
    out, size = text, n_bytes(text)
    for _, stage in stages:
        out = stage(out, ctx)
        if size and n_bytes(out) > MOST_EXPANSION * size:
            ctx.rules_fired.clear()
            return text
    return out


def clean_text(text: str, config: Config | None = None, names: list[str] | None = None) -> tuple[str, Context]:
    config = config or Config()
    ctx = Context(profile=config.profile, input_size_bytes=n_bytes(text))
    if ctx.input_size_bytes > config.settings.max_input_bytes:
        ctx.skipped_oversize = True
        return text, ctx
    if config.settings.sensitive_filter and secret_in(text):
        ctx.skipped_sensitive = True
        return text, ctx
    return run_stages(text, stages_of(config, names), ctx), ctx


def clean(df: DataFrame, text_col: str = "text", config: Config | None = None, names: list[str] | None = None, out_col: str = "cleaned", ctx_col: str = "ctx") -> DataFrame:
    """df with the cleaned text and the context of each row, which replace columns of these names; null stays null. Runs no job: a
    caller with fewer files than cores may repartition df first."""
    config = config or Config()
    keep = [c for c in df.columns if c.lower() not in (out_col.lower(), ctx_col.lower())]
    big, secret, active, size = free_names(df, "big", "secret", "active", "size")
    text = named(text_col)
    flagged = df.withColumn(big, native.is_oversize(text, config.settings.max_input_bytes))
    flagged = flagged.withColumn(secret, ~F.col(big) & native.has_secret(text) if config.settings.sensitive_filter else F.lit(False))
    flagged = flagged.select(*map(named, keep), text.alias(active), F.octet_length(text).cast("bigint").alias(size), big, secret)
    schema = StructType([*(df.schema[c] for c in keep), StructField(out_col, StringType()), StructField(ctx_col, StructType.fromDDL(f"c {CONTEXT_DDL}")["c"].dataType)])
    n, registered, profile = len(keep), dict(REGISTERED), config.profile
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        REGISTERED.update(registered)
        stages = stages_of(config, names)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                texts, contexts = [], []
                for t, size, big, secret in zip(*(part.column(n + i).to_pylist() for i in range(4)), strict=True):
                    if t is None:
                        texts.append(None)
                        contexts.append(None)
                        continue
                    ctx = Context(profile=profile, input_size_bytes=size, skipped_oversize=bool(big), skipped_sensitive=bool(secret))
                    texts.append(t if big or secret else run_stages(t, stages, ctx))
                    contexts.append(vars(ctx) | {"rules_fired": [{"stage": s, "description": d, "chars_changed": c} for s, d, c in ctx.rules_fired]})
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *(pa.array(c, arrow.field(n + i).type) for i, c in enumerate((texts, contexts)))], schema=arrow)

    return plain(flagged).mapInArrow(run, schema)


def clean_cell(table: Column, row: int, column: int) -> Column:
    """A cell of a table by its place, cleaned, and what to say about it: struct<cleaned, label>."""

    @pandas_udf("struct<cleaned:string,label:string>")
    def run(cells: pd.Series) -> pd.DataFrame:
        out, place = [], f"Copied cell r{row + 1}c{column + 1}"
        for c in cells:
            cleaned, ctx = clean_text(c or "")
            said = summary([stage for stage, _, _ in ctx.rules_fired])
            out.append((cleaned, place if not ctx.rules_fired else f"{place} · {said}"))
        return pd.DataFrame(out, columns=["cleaned", "label"])

    return run(native.cell(table, row, column))
