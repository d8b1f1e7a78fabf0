"""The queries that put fragments into whole texts, against brute force."""

import json

import pytest

from quillsift.operators import characters, codespans, layout
from quillsift.plans import queries

BAR = "|"
TEXTS = ["A first line.\nA second line with some more words in it", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "one", "word " * 20_000, "x" + " and so on" * 30 + "\n  gap    here  \n\nsudo rm -f /tmp/a\n`ls -l`\nend snake_case", "gh" + "p_" + "a" * 36 + " in the middle " * 9, ""]
ROWS = [(i + 10 * k, t, "en", "src") for k in range(9) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([*ROWS, (99, None, "en", "src")], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows(spark, sf, name):
    return [r for r in queries.QUERIES[name](spark, sf).collect() if r.doc_id != 99]


def dirty(spark, sf, sql):
    return {r.doc_id: r.text for r in queries.docs(spark, sf, sql).collect() if r.doc_id != 99}


def test_whole_texts_stay(spark, sf):
    text = {i: t for i, t, *_ in ROWS}
    for sql in (queries.SECRET_AT_END, queries.DIRTY_TOKENS, queries._WITH_COMMANDS):
        assert all(text[i] in t for i, t in dirty(spark, sf, sql).items())


def test_secrets(spark, sf):
    found = dirty(spark, sf, queries.SECRET_AT_END)
    got = {r.doc_id: r.pattern for r in rows(spark, sf, "secret_pattern_whole")}
    assert got == {i: characters.secret_in(t) for i, t in found.items()} and len(set(got.values())) > 3


def test_json(spark, sf):
    text, kinds = {i: t for i, t, *_ in ROWS}, set()
    for r in rows(spark, sf, "json_pretty_whole"):
        value = {"text": text[r.doc_id], "lang": "en", "a": [r.doc_id, None]}
        assert json.loads(r.cleaned) == value
        kinds.add(r.content_type)
        if characters.secret_in(text[r.doc_id]) is None:
            assert r.content_type == "Json" and r.cleaned == json.dumps(value, indent=2, sort_keys=True)
    assert "Json" in kinds


def test_delimited(spark, sf):
    text = {i: t for i, t, *_ in ROWS}
    got = {r.doc_id: r.cleaned for r in rows(spark, sf, "markdown_of_delimited_whole")}
    for i in (0, 3, 10, 23):
        exp = [f"| {i} | {x.strip()} |" for x in text[i].split("\n")]
        assert got[i].split("\n") == ["| number of the document | its text |", "| --- | --- |", *exp]


def test_codespans(spark, sf):
    found = dirty(spark, sf, queries.DIRTY_TOKENS)
    for r in rows(spark, sf, "codespans_whole"):
        t = found[r.doc_id]
        assert r.cleaned.replace("`", "").strip() == t.replace("`", "").strip()
        if r.doc_id % 10 in (0, 2, 3):
            assert r.cleaned == "\n".join(" ".join(map(codespans.wrap_token, x.split(" "))) for x in t.split("\n"))


def test_tables(spark, sf):
    text, got = {i: t for i, t, *_ in ROWS}, {}
    for r in rows(spark, sf, "table_rows_whole"):
        got.setdefault(r.doc_id, {})[r.row_no] = r.cells
    gate = {r.doc_id: r for r in rows(spark, sf, "table_gate_whole")}
    for i, t in text.items():
        exp = [["a", "b"], ["1", "2"], ["3", "4"]] if BAR in t else [["line", "text"], *([str(n), x.strip()] for n, x in enumerate(t.split("\n")))]
        assert [got[i][n] for n in range(len(got[i]))] == exp
        if i % 2 == 0 or BAR in t:
            assert gate[i].detected and gate[i].rows == exp
        elif gate[i].detected:
            assert gate[i].rows == exp
        else:
            assert gate[i].rows == [] and "below threshold" in gate[i].warning


def test_commands_and_padding(spark, sf):
    text, found = {i: t for i, t, *_ in ROWS}, dirty(spark, sf, queries._WITH_COMMANDS)
    got = {(r.doc_id, r.line_no): r.command for r in rows(spark, sf, "shell_commands_whole")}
    assert got == {(i, n): layout.is_shell_command(x) for i, t in found.items() for n, x in enumerate(t.split("\n"))} and any(got.values())
    wrap = lambda x: x if not (o := x.strip()) or o.startswith("#") or (o.startswith("`") and o.endswith("`")) else f"`{o}`"
    assert {r.doc_id: r.text for r in rows(spark, sf, "wrapped_commands_whole")} == {i: "\n".join(map(wrap, f"{t}\n# note\n ls ".split("\n"))) for i, t in found.items()}
    got = {(r.doc_id, r.line_no): r.line for r in rows(spark, sf, "collapsed_padding_whole")}
    assert got == {(i, n): layout.squeeze(" " * (i % 30) + x + "    x   ")[0] for i, t in text.items() for n, x in enumerate(t.split("\n"))}
