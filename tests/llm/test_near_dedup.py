import random
import re

import pytest

from quillsift.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for c, (d, _) in zip(comp, rows, strict=True):
        least[c] = min([x for x in (least.get(c), d) if x is not None], default=None)
    return sorted(((d, len(s), least[c]) for (d, _), s, c in zip(rows, sets, comp, strict=True)), key=str)


def edited(words, n, r):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(40)}"
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    r = random.Random(percent)
    rows, n = [], 0
    for size in (140, 60, 300):
        base = [f"w{r.randrange(1000)}" for _ in range(size)]
        for _ in range(70):
            rows.append((n, " ".join(edited(base, r.randrange(8), r))))
            n += 1
    rows += [(n, rows[3][1]), (n + 1, "A b\tC d\ne"), (n + 2, "a B c D E"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, ""), (n + 6, None), (None, rows[5][1]), (9, rows[80][1]), (9, rows[9][1]), (9, rows[9][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").selectExpr("*", "doc_id AS `a.b`", "text AS Mark", "1 AS key").repartition(5)
    got = near_dedup.near_duplicates(df, percent=percent, halves=20).collect()
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str) == brute(rows, percent)
    one = near_dedup.one_of_each(df, percent=percent, halves=20).collect()
    assert all(o["a.b"] == o.doc_id and o.Mark == o.text and o.key == 1 for o in one)
    assert len([o for o in one if shingles(o.text)]) == len({g.component for g in got if g.component}) and len([o for o in one if not shingles(o.text)]) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 0 and near_dedup.one_of_each(df).count() == 0
