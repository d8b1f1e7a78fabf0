import io
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsift import cli
from quillsift.functions import native
from quillsift.functions.chars import FENCE, MOJIBAKE
from quillsift.operators import characters, classify, cleaner, codespans, diff, layout, links, richtext, rules, strict_json, structure, tables
from quillsift.operators.base import Context, summary
from quillsift.sources.config import Config, Settings

TEXTS = st.text(alphabet=st.sampled_from(list("ab.:-*`|,;\t \n\r1)•◦⏺\x1b[m“—​{}\"é$/\\#")), max_size=120)


def run(stage, text, kind=None):
    ctx = Context(content_type=kind)
    return stage(text, ctx), ctx


def test_unicode():
    out, ctx = run(characters.unicode_stage(), "“a” — b c​ é")
    assert out == '"a" -- b c é' and ctx.rules_fired[0][0] == "normalize_unicode"
    assert run(characters.unicode_stage(""), "a—b")[0] == "a—b"
    bad = " ".join(b for b, _ in MOJIBAKE[:3])
    assert characters.repair_mojibake(bad + "\n\n" + MOJIBAKE[0][0]) == (" ".join(g for _, g in MOJIBAKE[:3]) + "\n\n" + MOJIBAKE[0][0], 3)


def test_artifacts():
    out, ctx = run(characters.artifact_stage, "  ⏺⏺ a\n\x1b[1;31mb\x1b[0m‍\x1b[?25l")
    assert out == "  a\nb\x1b[?25l" and ctx.rules_fired


def test_secrets():
    made = {"aws": "AK" + "IA" + "A" * 16, "github": "gh" + "p_" + "a" * 36, "base64": "Ab1+" * 12, "slack": "xo" + "xb-" + "1" * 12, "jwt": "ey" + "J" + "a" * 12 + "." + "b" * 12}
    assert {name: characters.secret_in(t) for name, t in made.items()} == {name: name for name in made}
    assert characters.secret_in("plain text https://example.com/a") is None
    out, ctx = cleaner.clean_text("“" + made["aws"] + "”")
    assert out.startswith("“") and ctx.skipped_sensitive
    assert cleaner.clean_text("“a”", Config(Settings(max_input_bytes=3)))[1].skipped_oversize


def test_layout():
    assert layout.unwrap("one line\nthat wraps\n\nnext") == "one line that wraps\n\nnext"
    assert layout.unwrap("  • a\n    more\n  • b") == "- a more\n- b"
    assert layout.unwrap(f"{FENCE}py\n  x\n{FENCE}\ntail") == f"{FENCE}py\n  x\n{FENCE}\n\ntail"
    assert layout.unwrap("Steps:\nrm -f x\nnow done") == "Steps:\nrm -f x\nnow done"
    assert layout.unwrap("a   b" + "\n" + " " * 25 + "c") == "a b\n\nc"
    assert layout.terminal_width(["x" * 80] * 3 + ["y" * 50]) == 80 and layout.terminal_width(["x" * 80] * 2) == 0
    assert run(layout.layout_stage, "curl -s \\\n  http://x\n\nls -l", "ShellBlock")[0] == "curl -s http://x\n\nls -l"
    assert layout.is_shell_command("sudo rm -f x") and not layout.is_shell_command("open the file") and layout.is_shell_command("`ls -l`")


def test_structure():
    assert run(structure.structure_stage, '{"b": 1e16, "a": [1.0, {}]}')[0] == '{\n  "a": [\n    1.0,\n    {}\n  ],\n  "b": 1e16\n}'
    assert strict_json.parse('{"a":1} x') is None and strict_json.parse("NaN") is None and strict_json.parse("1e400") is None and strict_json.parse("null") is not None
    assert run(structure.structure_stage, "number of the row,its full name\n1,somebody\n2,another")[0] == "| number of the row | its full name |\n| --- | --- |\n| 1 | somebody |\n| 2 | another |"
    assert run(structure.structure_stage, "a,b\n1,2")[0] == "a,b\n1,2"  # the table would be over twice as long
    code = "def f(x):\n    import os\n    y = 1;\n    z = 2;\n    print(y)"
    assert run(structure.structure_stage, code)[0] == f"{FENCE}python\n{code}\n{FENCE}"
    assert structure.language_of("package fmt.x private System.out") == "java"  # of equals the later
    assert structure.pretty_json('{"a":  [1]}', flat=True) == '{"a":[1]}'


@pytest.mark.parametrize(
    ("text", "kind"),
    [("[1]", "Json"), ("12", "Json"), ("a,b,c\n1,2,3", "Table"), ("https://x.org/a", "Url"), ("$ ls\n# note", "ShellBlock"), ("- a\n- b\nc", "List"), ("hello there", "Prose"), ("", "Prose"), ("a b\nc d\ne f", "Mixed"), ("#!x\na\nb\nc", "Code"), ("a\n  b\n  c\n  d", "Code")],
)
def test_classify(text, kind):
    assert classify.classify(text) == kind


def test_tables():
    box = "┌───┬───┐\n│ a │ b │\n├───┼───┤\n│ 1 │ 2 │\n│   │ x │\n└───┴───┘"
    t = tables.extract_table(box)
    assert (t.format, t.rows) == ("terminal", [["a", "b"], ["1", "2 x"]]) and abs(t.confidence - 0.92) < 1e-6
    assert tables.extract_table("| a | b |\n|---|---|\n| 1 | 2 |").format == "markdown"
    assert tables.extract_table("a\tb\n1\t2").rows == [["a", "b"], ["1", "2"]]
    assert tables.split_delimited('a,"b ""x"", c",d', ",") == ["a", 'b "x", c', "d"]
    assert not tables.extract_table("Hello, you\nand me, too").detected
    assert "below threshold" in tables.extract_table("a | b\nc | d").gated(True, 0.9).warnings[-1]
    assert tables.cell(t, 1, 0) == "1" and tables.cell(t, 9, 0) == ""
    assert tables.extract_table(box.replace("\n", " ")).rows == [["a", "b"], ["1", "2 x"]]


def test_links():
    clean = links.clean_url
    assert clean("https://www.Example.com/?utm_source=a&q=x%26y#f") == "https://example.com/?q=x%26y#f"
    assert clean("http://x.org:80/a/../b?fbclid=1") == "http://x.org/b" and clean("https://x.org") == "https://x.org"
    assert clean("https://x.org/?si=1", domains={"x.org": {"keep": ["si"], "deny": ["q"]}}) == "https://x.org/?si=1"
    assert clean("https://x.org/a", strip_scheme=True) == "x.org/a" and clean("https://") is None
    text = f"see https://www.a.org/?gclid=1) and `https://www.a.org/?gclid=1`\n{FENCE}\nhttps://www.a.org\n{FENCE}"
    assert run(links.link_stage(), text)[0] == f"see https://a.org) and `https://www.a.org/?gclid=1`\n{FENCE}\nhttps://www.a.org\n{FENCE}"


def test_codespans():
    wrap = codespans.wrap_token
    assert [wrap(x) for x in ("--flag", "(a_b),", "run(x).", "camelCase", "ABCD", "ABC", "h:80", "$X", "a.b", "word", "https://x.org/a_b")] == ["`--flag`", "(`a_b`),", "`run(x)`.", "`camelCase`", "`ABCD`", "ABC", "`h:80`", "`$X`", "`a.b`", "word", "https://x.org/a_b"]
    assert run(codespans.codespan_stage, "ls -l\n# c\n`x`", "ShellBlock")[0] == "`ls -l`\n# c\n`x`"


def test_rules():
    out, ctx = run(rules.rule_stage([rules.Rule("swap", r"(\w+) (?<n>\w+)", "${n} $1$$"), rules.Rule("none", "zzz", "")]), "a b")
    assert out == "b a$" and [r[1] for r in ctx.rules_fired] == ["rule 'swap' fired"]
    for bad in ("(?=a)", "(?<!a)b", r"(a)\1", "a++", "a{2}+", "(", "(a+)+b", r"(?:\w+\s*)*x", "(x{1,})+", "(?>a)", "(?R)", r"\Ga", "a(?m)b$"):
        with pytest.raises(rules.RuleError, match="'r'"):
            rules.compiled(rules.Rule("r", bad, ""))


@pytest.mark.parametrize(
    ("pattern", "replacement", "text", "out"),
    [
        ("x$", "Y", "x\n", "x\n"), ("x$", "Y", "ax", "aY"), (r"x\z", "Y", "x", "Y"), ("x*", "-", "abxd", "-a-b-d-"), ("", "-", "ab", "-a-b-"), (r"\p{L}+", "w", "é1", "w1"), ("[[:alpha:]]+", "w", "ab1", "w1"),
        (r"(?m)^a$", "X", "a\na\nb", "X\nX\nb"), ("[]a]+", "X", "]a", "X"), (r"\x{41}", "X", "A", "X"), (r"\++", "X", "a++", "aX"), ("(ab)+", "X", "abab", "X"), ("a+?", "X", "aa", "XX"), (r"\$5", "X", "$5", "X"), ("[$]", "X", "$", "X"),
        ("(a)(b)?", "[$2$1]", "a ab", "[a] [ba]"),
    ],
)
def test_rule_dialect(pattern, replacement, text, out):
    assert rules.replaced(rules.compiled(rules.Rule("r", pattern, replacement)), replacement, text)[0] == out


def test_rule_time(monkeypatch):
    """A rule that runs too long on a text leaves it, and the context says so."""
    monkeypatch.setattr(rules, "MOST_SECONDS", 0.05)
    slow = rules.Rule("slow", "(?:a|a|ab)(?:a|b|ab){0,40}(?:a|ab|b){0,40}[cd]", "x")
    monkeypatch.setattr(rules, "replaced", lambda p, r, t, s=0.05, f=rules.replaced: f(p, r, t, s))
    out, ctx = run(rules.rule_stage([slow, rules.Rule("b", "b", "B")]), "ab" * 40)
    assert out == "aB" * 40 and [r[1] for r in ctx.rules_fired] == ["rule 'slow' timed out after 0.05s", "rule 'b' fired"]


def test_summary_and_diff_and_rich_text():
    assert summary([]) == "No changes needed" and summary(["agent_strip", "agent_strip", "url_cleaning", "user_rules"]).endswith("+1 more")
    assert list(diff.line_diff("a\nb", "a\nc")) == [(" ", "a"), ("-", "b"), ("+", "c")] and not list(diff.line_diff("a", "a"))
    assert list(diff.line_diff("a\nb\nc\nd", "a\nc\nx\nd")) == [(" ", "a"), ("-", "b"), (" ", "c"), ("+", "x"), (" ", "d")]
    assert richtext.rich_text("<p>Use <code>ls</code> now</p><ul><li>a</li></ul>") == "Use `ls` now\n- a"
    assert richtext.better_text("x", "a long plain text") == "a long plain text" and richtext.better_text("- a", "a") == "- a" and richtext.better_text("a", "- a") == "- a"
    assert richtext.better_text(None, "") is None and richtext.better_text("use run_it", None) == "use `run_it`" and richtext.better_text("x", "") == "x"
    coloured = {"color:#ff0000": True, "color:#777": False, "color: rgba(255, 0, 0, .5)": False, "color: rgb(10% 90% 0%)": True, "color:#f00f": True, "color:#ff000080": False, "color:navy": True, "color: gray": False, "background-color: red": False, "color:none": False, "color:rgb(1)": False}
    assert {x: richtext.is_coloured(x) for x in coloured} == coloured


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.booleans())
def test_diff_gives_both_texts(a, b, bounded):
    """Rows without `+` are the text before, rows without `-` the text after, whatever the bound."""
    x, y = "\n".join(a), "\n".join(b)
    most, diff.MOST_PAIRS = diff.MOST_PAIRS, 0 if bounded else diff.MOST_PAIRS
    try:
        rows = list(diff.line_diff(x, y))
    finally:
        diff.MOST_PAIRS = most
    assert x == y and not rows or ("\n".join(t for s, t in rows if s != "+"), "\n".join(t for s, t in rows if s != "-")) == (x, y)


def test_expansion_takes_everything_back():
    cleaner.register_stage("double", lambda t, ctx: t * 9)
    try:
        out, ctx = cleaner.clean_text("“a”")
        assert out == "“a”" and ctx.rules_fired == []
    finally:
        cleaner.REGISTERED.clear()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_cleaning_is_bounded_and_character_stages_settle(text):
    out, _ = cleaner.clean_text(text, Config(Settings(auto_wrapper=True)))
    assert len(out.encode()) <= max(2 * len(text.encode()), 0)
    once = run(characters.unicode_stage(), text)[0]
    assert run(characters.unicode_stage(), once)[0] == once


def test_older_tokens():
    older = [t for t in ("--f", "a_b", "/x", "a/b.c", "ABC", "AB", "aB", "ab", "f(x)", "a.bc", "x.py:٣", "a.b.c d") if codespans.is_older_code_token(t)]
    assert older == ["--f", "a_b", "/x", "a/b.c", "ABC", "AB", "aB", "a.bc", "x.py:٣"] and codespans.wrap_token("(f(x)", codespans.is_older_code_token) == "(f(x)"


def test_native_twins(spark):
    from pyspark.sql import functions as F

    lines = ["٣. x", "x.py:٣", "h:٣", "rm -f x", "open the door", "sudo ls ~", "- a", "1) b", "a_b", "--x", "", "   c    d  ", "ABCD", "aB", "x.py:1", "  ⏺ z", "\x1b[1mq"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    t = F.col("t")
    got = df.select("t", native.is_shell_command(t), native.is_list_item(t), native.is_code_token(t), native.collapsed_padding(t), native.without_artifacts(t)).collect()
    for r in got:
        assert (r[1], r[2], r[4], r[5]) == (layout.is_shell_command(r[0]), layout.is_list_item(r[0]), layout.squeeze(r[0])[0], characters.artifact_stage(r[0], Context())), r[0]
        assert r[3] == codespans.is_code_token(r[0]) or " " in r[0], r[0]


def test_clean_over_a_column(spark):
    df = spark.createDataFrame([(1, "“a”\nb"), (2, None), (3, "x" * 50), (4, "")], "id long, text string")
    got = {r.id: r for r in cleaner.clean(df, config=Config(Settings(max_input_bytes=20))).collect()}
    assert got[1].cleaned == '"a" b' and got[2].cleaned is None and got[2].ctx is None and got[3].ctx.skipped_oversize and got[3].cleaned == "x" * 50 and got[4].cleaned == ""


def test_clean_keeps_columns_of_any_name(spark):
    """No name of the caller's clashes, and building the result runs no job."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "“a”", 5, True, "o", "c", 2, 3)], "_big int, text string, big int, secret boolean, Cleaned string, active string, size int, `a.b` int")
    df = df.withColumnRenamed("`a.b`", "a.b")
    grouped = df.distinct().withColumn("count", F.lit(1))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("clean", "clean")
    out = cleaner.clean(grouped, config=Config(Settings(max_input_bytes=20)))
    assert not tracker.getJobIdsForGroup("clean")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    row = out.first()
    assert out.columns == ["_big", "text", "big", "secret", "active", "size", "a.b", "count", "cleaned", "ctx"] and row["a.b"] == 3
    assert (row["_big"], row["big"], row["secret"], row["active"], row["size"], row["cleaned"], row["ctx"]["skipped_oversize"]) == (1, 5, True, "c", 2, '"a"', False)


def test_cli(monkeypatch, capsys, tmp_path):
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO("“a”\n".encode())))
    assert cli.main(["--config", str(tmp_path / "none"), "--normalize"]) == 0
    assert capsys.readouterr().out == '"a"\n'
    bad = tmp_path / "c.toml"
    bad.write_text("[settings]\nmax_input_bytes = 0\n")
    bad.chmod(0o600)
    assert cli.main(["--config", str(bad), "validate"]) == 1 and "max_input_bytes" in capsys.readouterr().out


def test_doctor(tmp_path, capsys):
    """What is wrong is said, and counts."""
    own = tmp_path / "c.toml"
    assert cli.main(["--config", str(own), "doctor"]) == 0 and "defaults hold" in capsys.readouterr().out
    own.write_text('[settings]\nsensitive_filter = false\nauto_wrapper = true\n[[rules]]\nname = "r"\npattern = "(a+)+"\nreplacement = ""\n')
    own.chmod(0o600)
    (tmp_path / "manifest.json").write_text('{"parts": ["rows-x"], "batches": []}')
    assert cli.main(["--config", str(own), "--folder", str(tmp_path), "doctor"]) == 1
    said = capsys.readouterr().out
    assert "rule 'r'" in said and "missing ['rows-x']" in said and said.count("needs a look") == 2
    own.write_text("[settings]\nsensitive_filter = false\n")
    assert cli.main(["--config", str(own), "doctor"]) == 1 and "secret filter: off" in capsys.readouterr().out
    own.chmod(0o666)
    assert cli.main(["--config", str(own), "doctor"]) == 1 and "permissions 666" in capsys.readouterr().out
