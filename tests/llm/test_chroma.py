import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillsift.llm import chroma, common

P = chroma.Printer(8000, 1024, 256, 220.0, 3600.0)


def tune(n, seed):
    """n steps of 256 samples, a new tone every four."""
    g, t = np.random.default_rng(seed), np.arange(n * 256) / 8000
    pitch = np.repeat(g.integers(0, 24, -(-n // 4)), 1024)[: n * 256]
    return np.clip(np.sin(2 * np.pi * 330 * 2 ** (pitch / 12) * t) * 100 + 128, 0, 255).astype(np.uint8).tobytes()


def ints(blob):
    return P.prints(chroma.Pcm([blob], 8, P.least))[0]


def run(spark, rows, **how):
    return {r.media_id: r for r in chroma.recordings(spark.createDataFrame(rows, "media_id long, pcm binary"), **how).collect()}


def test_integers():
    """The integral image against plain sums, and blocks against one piece."""
    raw = np.frombuffer(tune(60, 1), np.uint8)
    got = ints(raw.tobytes())
    image = P.chroma(np.lib.stride_tricks.sliding_window_view(raw.astype(np.float32) - 128, 1024)[::256]).astype(float)
    assert len(got) == len(image) - chroma.WINDOW + 1
    for t in range(len(got)):
        bits = 0
        for parts, step in chroma.filters():
            v = round(sum(s * image[t + x0 : t + x1, y0:y1].sum() for s, y0, y1, x0, x1 in parts), 5)
            level = int(v > -step) + int(v > 0) + int(v > step)
            bits = bits << 2 | (level ^ level >> 1)
        assert bits == got[t]


def test_blocks(monkeypatch):
    blobs = [tune(n, n) for n in (5, 90, 1, 33)] + [b"", b"abc"]
    whole = P.prints(chroma.Pcm(blobs, 8, P.least))
    monkeypatch.setattr(chroma, "BLOCK", 7)
    for a, b, blob in zip(whole, P.prints(chroma.Pcm(blobs, 8, P.least)), blobs, strict=True):
        assert a.tolist() == b.tolist() == ints(blob).tolist()
    assert len(whole[4]) == 0 and len(whole[5]) == 1
    wide = b"".join(int((x - 128) * 256).to_bytes(2, "little", signed=True) for x in blobs[1])
    assert P.prints(chroma.Pcm([wide], 16, P.least))[0].tolist() == whole[1].tolist()


def plain(x, y, max_ber, sample=chroma.SAMPLE, least=chroma.LEAST, per_cent=10):
    """align() by plain Python: histogram of offsets, stretches, bit errors, and whether the two are linked."""
    def first(p):
        out = {}
        for i, h in enumerate(chroma.runs(p).tolist()):
            out.setdefault(h, i)
        return out

    hx, hy = first(x), first(y)
    bins = {}
    for h in hx.keys() & hy.keys():
        bins.setdefault(hy[h] - hx[h], []).append(hx[h])
    in_x, in_y, found = set(), set(), []
    for o, at in sorted(bins.items(), key=lambda b: (-len(b[1]), b[0])):
        here = range(min(at), max(at) + chroma.RUN)
        if in_x.issuperset(here):
            continue
        errors = sum(bin(int(x[i]) ^ int(y[i + o])).count("1") for i in here)
        if fits := errors <= max_ber * 32 * len(here):
            in_x.update(here)
            in_y.update(i + o for i in here)
        found.append((not fits, len(found), len(at), o, len(here), errors))
    if not found:
        return None
    def smallest(h):
        return set(sorted(h)[: max(sum(v < 2**64 // sample for v in h), least)])

    mx, my = smallest(hx), smallest(hy)
    _, _, shared, offset, overlap, errors = min(found)
    linked = 2 * min(len(in_x), len(in_y)) >= max(len(x), len(y)) and 100 * len(mx & my) >= per_cent * max(len(mx), len(my))
    return {"shared": shared, "offset": offset, "overlap": overlap, "bit_errors": errors, "linked": linked}


def test_alignment_of_two():
    g = np.random.default_rng(3)
    for _ in range(150):
        x = g.integers(0, 2**32, g.integers(1, 60), dtype=np.uint32)
        y = np.concatenate([g.integers(0, 2**32, g.integers(0, 9), dtype=np.uint32), x[g.integers(0, len(x)) :], x[: g.integers(0, 30)]])
        flip = g.random(len(y)) < 0.1
        y[flip] ^= np.uint32(1) << g.integers(0, 32, flip.sum(), dtype=np.uint32)
        assert chroma.align(x, y, 0.1, 10) == plain(x, y, 0.1)


def test_recordings(spark):
    a, b = tune(240, 1), tune(240, 2)
    noise = bytes(np.clip(np.frombuffer(a, np.uint8)[256 * 13 : 256 * 190] + np.random.default_rng(0).normal(0, 3, 256 * 177), 0, 255).astype(np.uint8))
    rows = [(1, a), (2, a[256 * 25 :]), (3, b), (4, noise), (5, a), (6, None), (7, b""), (8, b"abc"), (18, b"abd"), (None, a), (9, bytes([128]) * 9000), (None, b"abc")]
    got = run(spark, rows)
    assert (got[2].match_id, got[2].offset, got[2].bit_errors, got[2].aligned, got[2].component_id) == (1, 25, 0, True, 1)
    assert (got[4].offset in (13, -12)) and got[4].aligned and got[4].component_id == 1 and got[3].component_id == 3 and not got[3].aligned
    assert got[5].class_id == 1 and got[6].n_prints == got[7].n_prints == 0 and got[6].fingerprint is None and got[8].n_prints == 1 and got[8].class_id == 8 and got[18].class_id == 18
    assert run(spark, []) == {}
    clash = spark.createDataFrame([(1, a, 5)], "media_id long, pcm binary, fingerprint long").withColumns({"nid": F.lit(1), "marks": F.lit(2)})
    assert chroma.recordings(clash.unionByName(clash)).count() == 2


def test_recordings_against_brute_force(spark):
    """Near copies, others that share passages with many, and strangers: components equal those of all pairs, for sampled and for all marks."""
    g, passage = random.Random(1), tune(40, 99)
    rows, n = [], 0
    for s in range(4):
        base = tune(150, 10 + s)
        for _ in range(6):
            at, cut = 256 * g.randrange(150), 256 * g.randrange(0, 30)
            rows.append((n, base[cut:at] + tune(g.randrange(1, 9), 500 + n) + base[at:] if at > cut else base[cut:]))
            n += 1
    rows += [(100 + i, tune(60 + i, 200 + i) + passage + tune(50, 300 + i)) for i in range(12)]
    for how in ({}, {"sample": 1}, {"sample": 4, "least": 6}):
        prints = {i: ints(b) for i, b in rows}
        comp = {i: i for i in prints}
        for x, y in itertools.combinations(prints, 2):
            if (r := plain(prints[x], prints[y], chroma.MAX_BER, **{"sample": how.get("sample", chroma.SAMPLE), "least": how.get("least", chroma.LEAST)})) and r["linked"]:
                lo, hi = sorted((comp[x], comp[y]))
                comp = {i: lo if c == hi else c for i, c in comp.items()}
        got = run(spark, rows, **how)
        assert {i: r.component_id for i, r in got.items()} == comp and len(set(comp.values())) < 30
        for i, r in got.items():
            assert r.aligned == (list(comp.values()).count(comp[i]) > 1)
            if r.match_id is not None:
                p = plain(prints[i], prints[r.match_id], chroma.MAX_BER, **{"sample": how.get("sample", chroma.SAMPLE), "least": how.get("least", chroma.LEAST)})
                assert p["linked"] == r.aligned and (not r.aligned or p["overlap"] > 0)
        assert run(spark, rows[::-1], **how) == got


def test_tones():
    """A word is a chord, a line begins at a whole step, and other words shift the music by whole steps."""
    texts = ["a b c\nd e\n\nf", "x A  b\tc y\nd e\nf", "", " \n ", "one"]
    t = chroma.Tones(*common.text_bytes(pa.array(texts)), 2048, 2, 8 * chroma.TONE)
    word = {w: int(c) for w, c in zip("abcdefxy", chroma.Tones(*common.text_bytes(pa.array(["a b c d e f x y"])), 2048, 2, 0).codes, strict=True)}
    slots = np.split(t.codes, np.cumsum(t.sizes // chroma.TONE)[:-1])
    r = chroma.REST
    assert slots[0].tolist() == [word["a"], word["b"], word["c"], r, word["d"], word["e"], word["f"], r]
    assert slots[1].tolist() == [word[c] for c in "xabcy"] + [r, word["d"], word["e"], word["f"], r][: len(slots[1]) - 5]
    assert [len(x) for x in slots[2:]] == [0, 0, 8]
    p = chroma.Printer(2048, 512, 256, 500.0, 1024.0)
    heard = np.array([p.chroma(t.tones[np.full(8, c)].reshape(1, -1))[0] for c in range(r)])  # no two chords sound alike
    assert (np.sqrt(((heard[:, None] - heard[None]) ** 2).sum(2)) + np.eye(r)).min() > 0.05
    # the same words after others give the same integers, later
    whole, alone = (chroma.Printer(2048, 128, 64, 500.0, 1024.0).prints(chroma.Tones(*common.text_bytes(pa.array([x])), 2048, 1, 0))[0] for x in ("some words before\nthat " + "one two three four five six seven " * 3, "one two three four five six seven " * 3))
    assert whole[4:].tolist() == alone.tolist()
    # frames that are the same are transformed once, and give what they give alone
    t = chroma.Tones(*common.text_bytes(pa.array(["one two three four five six seven " * 9, "six two nine ten " * 5])), 2048, 1, 8 * chroma.TONE)
    fast, slow = chroma.Printer(2048, 128, 64, 500.0, 1024.0), chroma.Printer(2048, 128, 64, 500.0, 1024.0)
    slow.image = lambda media, starts: slow.chroma(media.frames(starts, 128))
    assert [x.tolist() for x in fast.prints(t)] == [x.tolist() for x in slow.prints(t)] and len(fast.rows) == 11


def test_tones_recall(spark):
    """Near copies of 0.8 and more among whole documents are found: 0.9 of them at least; unlike ones aren't."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) > 900]
    g, rows, planted = random.Random(4), [], 0

    def shingles(t):
        w = word.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    unique = []
    for t in docs:
        if all(len(shingles(t) & shingles(u)) < 0.05 * len(shingles(t)) for u in unique):
            unique.append(t)
    for i, t in enumerate(unique[:60]):
        lines = [x.split(" ") for x in t.split("\n")]
        for _ in range(max(1, sum(map(len, lines)) // 90)):
            own = g.choice([x for x in lines if x])
            at = g.randrange(len(own))
            own[at : at + g.randrange(2)] = ["other"] * g.randrange(1, 3)
        copy = "\n".join(map(" ".join, lines))
        a, b = shingles(t), shingles(copy)
        rows += [(2 * i, t), (2 * i + 1, copy if len(a & b) >= 0.8 * len(a | b) else None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.media_id: r for r in chroma.recordings(df, id_col="doc_id", media_col="text", how=chroma.TEXT).collect()}
    planted = [i for i, t in rows if i % 2 and t is not None]
    caught = [i for i in planted if got[i].component_id == i - 1]
    assert len(planted) > 25 and len(caught) >= 0.9 * len(planted), (len(planted), len(caught))
    assert all(r.component_id >= i - i % 2 for i, r in got.items())


def test_links_near_the_threshold(spark):
    """Pairs that share 60 per cent of all their runs and more are linked, whatever their smallest hashes are; those under it aren't."""
    g, rows, want = random.Random(7), [], {}
    p = chroma.Printer(2048, 2 * chroma.TONE, chroma.TONE, 500.0, 1024.0)
    for n in range(60):
        words = [f"w{g.randrange(10**9)}" for _ in range(200)]
        cut = g.randrange(50, 100)
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[cut:] + [f"v{g.randrange(10**9)}" for _ in range(cut)]))]
        x, y = (p.prints(chroma.Tones(*common.text_bytes(pa.array([t])), 2048, 1, p.least))[0] for _, t in rows[-2:])
        want[n] = plain(x, y, chroma.MAX_BER, 1, 0, 60)["linked"]
    got = {r.media_id: r for r in chroma.recordings(spark.createDataFrame(rows, "doc_id long, text string"), id_col="doc_id", media_col="text", how=chroma.TEXT).collect()}
    assert 5 < sum(want.values()) < 55 and {n: got[2 * n + 1].component_id == 2 * n for n in want} == want


def test_marks_that_meet():
    """Packed by blocks and met in shards, marks come out as the keys that several rows have; a row's own marks that begin alike count apart."""
    g, cut = np.random.default_rng(2), np.uint64(2 ** (64 - chroma.KEY_BITS) - 1)
    pool = g.integers(0, 2**64, 4000, dtype=np.uint64)
    pool = np.concatenate([pool, pool[:500] ^ np.uint64(1), pool[:100] & ~cut, np.array([0, 1, 2**64 - 1], np.uint64)])
    blocks = [[np.unique(g.choice(pool, n)) for n in g.integers(0, 300, 40)] for _ in range(3)] + [[np.empty(0, np.uint64), np.array([7, 2**64 - 1], np.uint64)]]
    sent, want = {}, {}
    for b, block in enumerate(blocks):
        for shard, blob in chroma.packed_marks(block):
            sent.setdefault(shard, []).append((b, blob))
        for r, own in enumerate(block):
            seen = {}
            for m in own.tolist():
                m >>= 64 - chroma.KEY_BITS
                seen[m] = seen.get(m, -1) + 1
                want.setdefault(m, []).append((b * chroma.BLOCK_ROWS + r, m << 23 | seen[m]))
    expected = sorted(x for rows in want.values() if len({r for r, _ in rows}) > 1 for x in rows)
    got = [pair for shard, x in sent.items() for pair in zip(*(v.tolist() for v in chroma.shared_keys(shard, [b for b, _ in x], [blob for _, blob in x])), strict=True)]
    assert sorted(got) == expected and len(got) > 1000 and any(k & (1 << 23) - 1 for _, k in got)


def test_marks_are_not_written(spark, monkeypatch):
    """No table that the operator writes is as large as the marks of all recordings."""
    g, sizes = random.Random(3), {}
    rows = [(i, " ".join(f"w{g.randrange(10**9)}" for _ in range(400))) for i in range(200)]
    rows += [(200 + i, t + " and more") for i, t in rows[:20]]

    def weighed(df, label, write=chroma.materialise):
        out = write(df, label)
        path = out._table.removeprefix("file:")
        sizes[label] = max(sizes.get(label, 0), sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet")))
        return out

    monkeypatch.setattr(chroma, "materialise", weighed)
    got = {r.media_id: r for r in chroma.recordings(spark.createDataFrame(rows, "doc_id long, text string"), id_col="doc_id", media_col="text", how=chroma.TEXT).collect()}
    assert all(got[200 + i].component_id == i for i in range(20))
    assert max(sizes.values()) < 8 * 390 * len(rows) / 2, sizes


def test_what_travels(spark, monkeypatch):
    """Marks of equal texts go once, and texts go to each other as chords, a byte a word. Ids that are null or repeated change no class."""
    g, seen = random.Random(5), {}
    texts = [" ".join(f"w{g.randrange(10**9)}" for _ in range(400)) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None if i % 3 == 0 else 200 + i, t) for i, t in enumerate(texts)]
    near = [(500 + i, t + " and more") for i, t in enumerate(texts[:20])] + [(500, texts[1] + " or less"), (600, texts[2].upper()), (600, None), (600, "")]

    def watched(df, label, write=chroma.materialise):
        out = write(df, label)
        path = out._table.removeprefix("file:")
        keys = out.where("key is not null").count() if label == "marked" else 0
        seen.setdefault(label, (keys, sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))))
        return out

    monkeypatch.setattr(chroma, "materialise", watched)
    find = lambda rows: sorted(((r.media_id, r.class_id, r.component_id, r.aligned) for r in chroma.recordings(spark.createDataFrame(rows, "doc_id long, text string"), id_col="doc_id", media_col="text", how=chroma.TEXT).collect()), key=str)
    assert find(rows) == sorted(((i, texts.index(t), texts.index(t), False) for i, t in rows), key=str)
    assert seen.pop("marked")[0] == 0
    got = find(rows + near)
    assert [r for r in got if r[0] == 500] == [(500, 500, 0, True), (500, 500, 1, True)] and all((500 + i, 500 + i, i, True) in got for i in range(1, 20))
    assert [r for r in got if r[0] == 600] == [(600, 2, 2, True), (600, 600, 600, False), (600, 600, 600, False)]
    assert seen["centres"][1] < 2 * 400 * 21 + 4000, seen
    texts = pa.array(["one two three\nfour " * 9, None, "", "a"])
    t, p = chroma.Tones(*common.text_bytes(texts), 2048, 4, 5 * chroma.TONE), chroma.Printer(2048, 128, 64, 500.0, 1024.0)
    assert [x.tolist() for x in p.prints(chroma.Tones.of(t.slots(), 2048))] == [x.tolist() for x in p.prints(t)]


@pytest.mark.parametrize("how", [{"kind": "mp3"}, {"kind": "tones", "hop": 100}])
def test_options(how):
    with pytest.raises(ValueError):
        chroma.options(**how)
