import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tokenizers
from pyspark.sql import functions as F

from quillsift.llm import chroma, language_id, line_dedup, mixing, packing, queries, segment_sampling, token_counts, top_k, url_filters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- 1


def test_language_id(spark, docs):
    model = language_id.learn(docs.where(~language_id.held_out("doc_id")))
    got = language_id.identify(docs, model).where(language_id.held_out("doc_id")).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9 and all(0 <= r.score <= 1 for r in got)
    text = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 1500)).orderBy("doc_id").first().text[:1500] for lang in ("en", "de")}
    _, _, mixture = model.infer(text["en"] + " " + text["de"][:750])
    assert [x for x, _ in mixture] == ["en", "de"] and 0.5 < mixture[0][1] < 0.85
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, text["de"] * 40)], "id long, t string")
    assert [r.lang_pred for r in language_id.identify(odd, model, text_col="t").orderBy("id").collect()] == ["und", "und", "und", "de"]
    none = language_id.learn(spark.createDataFrame([(1, None, "en"), (2, "a", None)], "doc_id long, text string, lang string"))
    assert none.infer("abc")[0] == "und" and language_id.identify(odd.limit(0), model, text_col="t").count() == 0
    odd = odd.withColumns({"score": F.lit("own"), "Mixture": F.lit(1), "text": F.lit(2), "a.b`c": F.lit(3)})
    got = language_id.identify(odd.unionByName(odd), model, text_col="t").collect()
    assert got[0].asDict().keys() == {"id", "t", "text", "a.b`c", "lang_pred", "score", "mixture"} and len(got) == 8 and all(isinstance(r.score, float) and r.text == 2 for r in got)


def plain_mixture(model, text):
    """infer() by plain loops: EM over all languages, then sets of growing size as long as the penalised likelihood gains."""
    grams = Counter(language_id.grams(text).tolist())
    c = {g: n * language_id.DRAWS for g, n in grams.items()}
    k, total = len(model.langs), sum(c.values())

    def em(langs, share):
        for _ in range(model.rounds):
            new, mixed = dict.fromkeys(langs, 0.0), {}
            for g, n in c.items():
                mixed[g] = sum(float(model.p[g, i]) * share[i] for i in langs)
                for i in langs:
                    new[i] += n * float(model.p[g, i]) * share[i] / mixed[g]
            share = {i: v / total for i, v in new.items()}
        return share, sum(n * math.log(mixed[g]) for g, n in c.items())

    single = [sum(n * math.log(float(model.p[g, i])) for g, n in c.items()) for i in range(k)]
    chosen, best = {max(range(k), key=lambda i: (single[i], -i)): 1.0}, max(single)
    every, _ = em(range(k), dict.fromkeys(range(k), 1 / k))
    order = sorted(range(k), key=lambda i: (-every[i], i))
    for size in range(2, k + 1):
        langs = sorted(order[:size])
        share, now = em(langs, {i: every[i] / sum(every[j] for j in langs) for i in langs})
        if now - best <= model.penalty * math.log(total + 1):
            break
        chosen, best = share, now
    return {model.langs[i]: v / sum(chosen.values()) for i, v in chosen.items()}


def test_language_id_against_plain(spark, docs):
    model = language_id.learn(docs)
    own = [(r.text, r.lang) for r in docs.where("length(text) > 300").orderBy("doc_id").limit(24).collect()]
    texts = [t[:300] for t, _ in own] + [a[:400] + " " + b[:200] for (a, x), (b, y) in itertools.pairwise(own) if x != y] + ["a", "Ünïcode only"]
    for text in texts:
        exp, got = plain_mixture(model, text), dict(model.infer(text)[2])
        assert got == pytest.approx(exp, abs=2e-3), text
    assert sum(len(model.infer(t)[2]) > 1 for t in texts) > 3


def test_language_id_small_share(spark, docs):
    """A few hundred words of another language in a very long text are in the mixture."""
    model = language_id.learn(docs)
    words = {lang: " ".join(r.text for r in docs.where(F.col("lang") == lang).orderBy("doc_id").collect()).split() for lang in ("en", "de")}
    _, _, mixture = model.infer(" ".join((words["en"] * 20)[:20_000] + (words["de"] * 20)[1000:1250]))
    assert [x for x, _ in mixture][0] == "en" and 0.002 < dict(mixture)["de"] < 0.02


# ---- 2


def test_url_filters(spark):
    urls = ["http://www.Example.com/en/x?q", "https://a.example.com/en/", "x://y.net/fr/a#b", None, "none", "", "http://x.com", "http://x.com", "http:///en/", "http://b.net/es", "http://" + "a." * 300 + "com/" + "p/" * 200]
    df = spark.createDataFrame([(i if i else None, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def brute(url, rules):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:at].lower(), rest[at:].split("?")[0].split("#")[0]
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    for rules in (url_filters.RULES, [("com", "", "block"), ("example.com", "/e", "block"), ("example.com", "/en/", "allow"), ("net", "/fr", "allow"), ("net", "/fr", "block")], []):
        got = url_filters.judge_urls(df, url_filters.rules_table(spark, rules)).collect()
        assert sorted(((r.page_id or 0), r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *brute(u, rules)) for i, u in enumerate(urls))
    assert url_filters.judge_urls(df.limit(0), url_filters.rules_table(spark)).count() == 0
    # a URL of many dots and slashes, and keys of any name
    far = spark.createDataFrame([(1, "z", "x://" + "a." * 30_000 + "example.com/en/" + "p/" * 30_000)], "key long, suffix string, url string")
    assert [tuple(r)[:2] + (r.rule, r.verdict) for r in url_filters.judge_urls(far, url_filters.rules_table(spark), key_cols=("key", "suffix")).collect()] == [(1, "z", "example.com/en/", "block")]
    with pytest.raises(ValueError):
        url_filters.judge_urls(df, url_filters.rules_table(spark), key_cols=("host",))


# ---- 4


def test_token_counts(spark, docs):
    exact = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(1)
    texts = [t.text for t in docs.collect()] + ["", None, "a<|endoftext|>b <|endoftext|>", "aaaa" * 50, "İé😀 ½", "x" * 30_000] + ["".join(r.choice("ab \n<|endoftxi>é😀1.'st") for _ in range(r.randint(1, 60))) for _ in range(500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {g.doc_id: g for g in token_counts.count_tokens(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        n = len(exact.encode(t or "", add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    clash = token_counts.count_tokens(df.limit(9).withColumns({"N_TOKENS": F.lit("own"), "text_": F.lit(1)}), P.path("byte_bpe_50k.json"), P.PATTERN)
    assert clash.columns == ["doc_id", "text", "text_", "n_bytes", "n_tokens", "over_limit"] and all(g.n_tokens == got[g.doc_id].n_tokens for g in clash.collect())
    assert token_counts.count_tokens(df.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


# ---- 5


def fill(sizes, weights, share, most):
    budget, out, left = share * sum(sizes.values()), {}, dict(sizes)
    while left:
        pull = sum(weights[s] for s in left)
        full = [s for s in left if most * sizes[s] <= budget * weights[s] / pull + 1e-9]
        if not full:
            return out | {s: budget * weights[s] / pull for s in left}
        for s in full:
            out[s] = most * sizes[s]
            budget -= out[s]
            del left[s]
    return out


def test_mixing(spark, docs):
    odd = spark.createDataFrame([(None, "a b", "src0"), (9001, None, None), (9002, "", "z"), (9003, "x y z", None), (9003, "x y z", None), (9004, "w " * 3000, "tiny")], "doc_id long, text string, source string")
    df = docs.select("doc_id", "text", "source").unionByName(odd)
    got = mixing.mix(df).collect()
    source = {(r.doc_id, len((r.text or "").split())): r.source for r in df.collect()}
    taken, sizes, targets = Counter(), Counter(), {}
    for g in got:
        s = source[(g.doc_id, g.size)]
        taken[s] += g.taken
        sizes[s] += g.size
        targets[s] = g.target
        assert g.taken <= 2 * g.size and g.taken == g.copies * g.size and g.source == s
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    for s in sizes:
        assert targets[s] == pytest.approx(expected[s])
        assert abs(taken[s] - targets[s]) <= max(g.size for g in got if source[(g.doc_id, g.size)] == s)
    key = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert key(mixing.mix(df.repartition(7)).collect()) == key(got)
    rows = Counter((r.doc_id, r.text) for r in mixing.mixed_rows(df).collect())
    copies = Counter()
    texts = {(r.doc_id, len((r.text or "").split())): r.text for r in df.collect()}
    for g in got:
        copies[(g.doc_id, texts[(g.doc_id, g.size)])] += g.copies
    assert rows == +copies
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, most=1.5)


def queue(rows, weights, share, most):
    """The whole queue in plain Python, row by row: {row number: copies}; rows: (doc_id, text, source, spot)."""
    sizes, by = [len((t or "").split()) for _, t, _, _ in rows], {}
    for i, r in enumerate(rows):
        by.setdefault(r[2], []).append(i)
    total = {s: sum(sizes[i] for i in own) for s, own in by.items()}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    targets = fill(total, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share, most)
    turns = []
    for s, own in by.items():
        run = 0
        if targets[s] > 0:
            for e in range(most):
                for i in sorted(own, key=lambda i: (rows[i][3] % 2**64 >> 1, rows[i][3])):
                    run += sizes[i]
                    turns.append((run / targets[s], i))
    copies = Counter(i for f, i in turns if f <= 1 + 1e-12)
    left = sum(targets.values()) - sum(sizes[i] * n for i, n in copies.items())
    for f, i in sorted((f, i) for f, i in turns if f > 1 + 1e-12 and sizes[i]):
        if sizes[i] > left:
            break
        left -= sizes[i]
        copies[i] += 1
    return copies, targets


@pytest.mark.parametrize(("share", "most"), [(1.5, 2), (0.4, 1), (2.6, 3)])
def test_mixing_queue(spark, docs, share, most):
    """Copies of every document equal those of a plain queue."""
    df = docs.where("doc_id % 3 = 0").select("doc_id", "text", "source").unionByName(spark.createDataFrame([(9001, None, None), (9002, "", "z"), (9003, "x y z", None)], "doc_id long, text string, source string"))
    rows = [tuple(r) for r in df.select("doc_id", "text", "source", F.xxhash64(F.lit("shuffle"), "doc_id", "text")).collect()]
    exp, targets = queue(rows, (5, 2, 1), share, most)
    got = {r.doc_id: r for r in mixing.mix(df, share=share, most=most).collect()}
    for i, (doc_id, text, source, _) in enumerate(rows):
        assert got[doc_id].target == pytest.approx(targets[source]) and got[doc_id].copies <= most
        if text:
            assert got[doc_id].copies == exp[i], doc_id


def test_mixing_repeated_and_clashing(spark, monkeypatch):
    """Equal rows share their turns, whatever the portions; columns of any name pass through the mix; nothing depends on the parts."""
    rows = [(7, "a b c", "s", i) for i in range(37)] + [(8, "a " * 400, "s", 99), (9, "q " * 60, "t", 98), (7, "a b c", "t", 97)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, spot long").withColumns({c: F.lit("own") for c in ("_id", "_copies", "row", "mark", "_times", "each", "file_name", "place", "one")})
    for portion in (10_000, 5):
        monkeypatch.setattr(mixing, "PORTION", portion)
        for share in (0.3, 1.0, 1.5):
            got = mixing.mix(df, share=share).collect()
            assert len(got) == len(rows) and all(g.taken == g.copies * g.size and g.copies <= 2 for g in got)
            for s in ("s", "t"):
                own = [g for g in got if g.source == s]
                assert abs(sum(g.taken for g in own) - own[0].target) <= max(g.size for g in own)
            out = mixing.mixed_rows(df.repartition(5), share=share).collect()
            assert Counter((r.doc_id, r.source) for r in out) == +Counter({k: sum(g.copies for g in got if (g.doc_id, g.source) == k) for k in {(r[0], r[2]) for r in rows}})
            assert all(r._id == r.row == r.place == "own" for r in out) and max(Counter(r.spot for r in out).values(), default=0) <= 2



# ---- 7


def test_line_dedup(spark, docs):
    odd = [(5000, "A line of twenty chars!\nb"), (5001, " a line of twenty chars!\t\na line of twenty chars!"), (5002, "a line of TWENTY chars!"), (5003, None), (5004, ""), (None, "a line of twenty chars!"), (5005, "x" * 100_000)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + odd
    rows += rows[3:5]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, mark int")
    hold = {}
    for n, (i, t) in enumerate(rows):
        for k in {line_dedup.line_key(x) for x in (t or "").split("\n")}:
            hold.setdefault(k, {})[n] = -(2**63) if i is None else i
    exp = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := line_dedup.line_key(x)) >= 20 and len(hold[k]) >= 3 and max(hold[k].values()) != (-(2**63) if i is None else i))]
        exp[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    for how in ({}, {"shard_keys": 3, "group_mb": 0.0005, "part_lines": 10}):
        assert Counter((g.doc_id, g.n_lines, g.n_dropped, g.kept_text) for g in line_dedup.drop_repeated_lines(df, **how).collect()) == exp
        got = line_dedup.drop_repeated_lines(df.withColumns({"N_lines": F.lit("own"), "row": F.lit(1), "key": F.lit(2), "lines": F.lit(3)}), **how)
        assert got.columns == ["doc_id", "text", "mark", "row", "key", "lines", "kept_text", "n_lines", "n_dropped"] and got.where("key = 2 and row = 1 and lines = 3 and n_lines > 0").count() == len(rows)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_perfect_hash():
    g = np.random.default_rng(0)
    h1, h2 = g.integers(0, 2**64, 5000, dtype=np.uint64), g.integers(0, 2**64, 5000, dtype=np.uint64)
    h1[:100] = h1[100:200]
    s = line_dedup.Shard(line_dedup.build_shard(h1, h2, np.arange(5000), np.arange(5000) * 7))
    seat = s.seat(h1, h2)
    assert sorted(seat) == list(range(5000)) and (s.largest[seat] == np.arange(5000) * 7).all()
    assert (s.seat(h1, h2 + np.uint64(1)) == -1).all()


# ---- 8


def test_packing(spark, docs):
    encoder = packing.byte_bpe_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9000, None), (9001, ""), (9002, "long " * 5000)], "doc_id long, text string"))
    rows = packing.pack(df, encoder, row_len=128, pack_tokens=5000).collect()
    found, encode = packing.unpack(rows), encoder()
    for r in df.collect():
        assert found.get(r.doc_id, np.array([])).tolist() == encode([r.text or ""])[0]
    for r in rows:
        assert len(r.ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and r.position_resets == r.cu_seqlens[:-1]
    assert sum(r.n_tokens for r in rows) / (128 * len(rows)) > 0.95
    g = np.random.default_rng(2)
    for _ in range(40):
        sizes, room, packed = g.integers(1, 41, g.integers(1, 200)), [], Counter()
        for n in sorted(sizes.tolist(), reverse=True):  # plain best fit
            fits = [(x, j) for j, x in enumerate(room) if x >= n]
            j = min(fits, key=lambda f: f[0])[1] if fits else len(room)
            room = room + [40] if not fits else room
            room[j] -= n
        packed = packing.best_fit_decreasing(sizes, 40)
        assert sorted(itertools.chain(*packed)) == list(range(len(sizes))) and sorted(40 - sizes[p].sum() for p in packed) == sorted(room)
    assert packing.pack(df.limit(0), encoder).count() == 0
    twice = packing.pack(df.limit(5).unionByName(df.limit(5)).withColumns({"ids": F.lit(1), "row": F.lit(2)}), encoder, row_len=128).collect()
    assert sum(r.n_tokens for r in twice) == 2 * sum(r.n_tokens for r in packing.pack(df.limit(5), encoder, row_len=128).collect())


# ---- 9


def test_top_k(spark):
    g = np.random.default_rng(3)
    rows = [(i - 5, [float(x) for x in g.normal(0, g.uniform(0.1, 3), 12)]) for i in range(400)]
    rows += [(1000, rows[3][1]), (1000, rows[3][1]), (1001, None), (1002, [float("nan")] * 12), (1003, [None] * 12), (1004, [1.0]), (None, rows[0][1]), (1050, [2.0]), (1100, []), (1101, [])]
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and not any(x is None or x != x for x in v)]
    exp = set()
    for q, v in ints:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in ints if i != q and len(c) == len(v))[:5]
            exp |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    df = spark.createDataFrame([(i, v, "a") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(6)
    for block in (4096, 3):
        assert set(map(tuple, top_k.top_k(df, F.col("id") % 20 == 0, block=block).collect())) == exp
    assert top_k.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_k_large(spark):
    """Components whose products leave 64 bits: exact ranks, and the nearest 64-bit integer as score."""
    rows = [(0, [3e30, 1.0]), (1, [3e30, 1.0]), (2, [1.0, 1.0]), (3, [-3e30, 0.0]), (4, [2.9e30, -5.0]), (5, [1e9, 1e9]), (6, [3e30, 2.0])]
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    got = {}
    for r in top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") >= 0, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in ints:
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q)
        assert got[q] == [(c, max(min(-s, 2**63 - 1), -(2**63))) for s, c in best]


def test_top_k_prunes():
    """Few of the pairs get an exact product, and a query is done with what is left of a task."""
    g = np.random.default_rng(5)
    low = g.normal(0, 1, (6, 32)) * np.linspace(3, 0.1, 6)[:, None]
    c = np.floor(256 * (g.normal(0, 1, (6000, 6)) @ low * np.exp(g.normal(0, 1, (6000, 1))) + g.normal(0, 0.01, (6000, 32))))
    c = c[np.argsort(-np.sqrt((c**2).sum(1)))]
    q = c[::60]
    block = top_k.Block(np.arange(0, 6000, 60), q, *top_k.axes(c.T @ c))
    best = top_k.Best(block, 5)
    for at in range(0, 6000, 1000):
        best.offer(np.arange(at, at + 1000), c[at : at + 1000])
    assert best.made < 0.05 * len(q) * len(c) and len(best.live) < len(q) / 2
    places, ids, scores = best.found()
    for j in range(0, len(q), 7):
        exact = (c.astype(np.int64) @ q[j].astype(np.int64)).tolist()
        exp = sorted((-s, i) for i, s in enumerate(exact) if i != 60 * j)[:5]
        assert [(-s, i) for p, i, s in zip(places, ids, scores, strict=True) if p == j] == exp


# ---- 10


def test_segment_sampling(spark, docs):
    path = P.path("piece_bpe_32k.model")
    lat = segment_sampling.lattice_of(path, 1.0)
    texts = [r.text for r in docs.limit(30).collect()] + ["", None, "the  cat", "日本x𓀀 ok", "y" * 20_000, "a"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, extra int")
    got = {r.doc_id: r.samples for r in segment_sampling.sample_segmentations(df, path, k=3).collect()}
    for i, t in enumerate(texts):
        assert all(lat.decode(s.ids) == t for s in got[i]) and len({tuple(s.ids) for s in got[i]}) == len(got[i])
        assert [s.perturbed for s in got[i]] == sorted((s.perturbed for s in got[i]), reverse=True)
    assert got[30] == got[31] == [] and len(got[35]) == 2 and got[35][0].log_inclusion == 0.0
    again = {r.doc_id: r.samples for r in segment_sampling.sample_segmentations(df.repartition(3), path, k=3).collect()}
    assert {i: [tuple(s.ids) for s in v] for i, v in got.items()} == {i: [tuple(s.ids) for s in v] for i, v in again.items()}
    assert segment_sampling.sample_segmentations(df.limit(0), path).count() == 0


def test_segment_ids_in_results(spark, docs):
    """The query and the pipeline's last stage return the ids, which give the texts back."""
    import corpus_pipeline

    lat, texts = segment_sampling.lattice_of(P.path("piece_bpe_32k.model"), 1.0), {r.doc_id: r.text for r in docs.collect()}
    for df in (queries.QUERIES["op10_segment_sampling"](spark, SF), corpus_pipeline.STAGES[-1][1](spark, docs, SF)):
        got = df.collect()
        assert len(got) == len(texts)
        for r in got:
            assert all(r.decoded) and all(lat.decode(i) == texts[r.doc_id] for i in r.ids) and r.n_samples == len(r.ids)
            assert r.n_pieces == [len(i) for i in r.ids] and r.ids_digest == [segment_sampling.ids_digest(np.array(i)) for i in r.ids]


def test_segment_distribution():
    lat = segment_sampling.lattice_of(P.path("piece_bpe_32k.model"), 1.0)
    weight = {lat.pieces[i]: w for i, w in zip(lat.ids, lat.log, strict=True)}

    def paths(s):
        return {(): 0.0} if not s else {(s[:n], *rest): weight[s[:n]] + w for n in range(1, len(s) + 1) if s[:n] in weight for rest, w in paths(s[n:]).items()}

    every = paths("▁thes")
    total = np.logaddexp.reduce(list(every.values()))
    p = {k: np.exp(v - total) for k, v in every.items()}
    n, first, pair = 8000, Counter(), Counter()
    for got in lat.sample(["thes"] * n, np.arange(n), 2):
        a, b = (tuple(lat.pieces[i] for i in s[0]) for s in got)
        assert got[0][1] == pytest.approx(np.log(p[a]), abs=1e-3)
        first[a] += 1
        pair[a, b] += 1
    for a, c in first.items():
        assert c / n == pytest.approx(p[a], abs=0.02)
    for (a, b), c in pair.items():  # without replacement
        assert c / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.02)


def test_segment_three_and_inclusion():
    """k = 3 comes without replacement, in the right proportions, and inclusion scores weigh samples so that sums over all paths come out."""
    lat = segment_sampling.lattice_of(P.path("piece_bpe_32k.model"), 1.0)
    weight = {lat.pieces[i]: w for i, w in zip(lat.ids, lat.log, strict=True)}

    def paths(s):
        return {(): 0.0} if not s else {(s[:n], *rest): weight[s[:n]] + w for n in range(1, len(s) + 1) if s[:n] in weight for rest, w in paths(s[n:]).items()}

    every = paths("▁then")
    total = np.logaddexp.reduce(list(every.values()))
    p = {k: float(np.exp(v - total)) for k, v in every.items()}
    n, triples, mass, pieces = 12_000, Counter(), [], []
    for got in lat.sample(["then"] * n, np.arange(n), 3, seed=5):
        own = [tuple(lat.pieces[i] for i in s[0]) for s in got]
        assert len(set(own)) == 3 and all(0 < math.exp(s[3]) <= 1 for s in got)
        triples[tuple(own)] += 1
        weights = [p[x] / math.exp(s[3]) for x, s in zip(own, got, strict=True)]
        mass.append(sum(weights))
        pieces.append(sum(w * len(x) for w, x in zip(weights, own, strict=True)))
    for (a, b, d), count in triples.items():
        assert count / n == pytest.approx(p[a] * p[b] / (1 - p[a]) * p[d] / (1 - p[a] - p[b]), abs=0.02)
    error = lambda x: 5 * np.std(x) / np.sqrt(n)
    assert np.mean(mass) == pytest.approx(1, abs=error(mass)) and np.mean(pieces) == pytest.approx(sum(len(x) * v for x, v in p.items()), abs=error(pieces))
    # equal rows have equal samples, whatever stands beside them; clashing columns are replaced
    assert [[s[0].tolist() for s in x] for x in lat.sample(["then", "other", "then"], np.array([7, 8, 7]), 3)][::2] == [[s[0].tolist() for s in lat.sample(["then"], np.array([7]), 3)[0]]] * 2


def test_segment_truncates_the_best_nodes_only(monkeypatch):
    """Truncated priorities are computed for the best node of each path, not for each place, and samples still come in their order."""
    lat, seen, plain = segment_sampling.lattice_of(P.path("piece_bpe_32k.model"), 1.0), [], segment_sampling._Slice._truncated
    monkeypatch.setattr(segment_sampling._Slice, "_truncated", lambda self, x, *more: seen.append(len(x)) or plain(self, x, *more))
    texts = ["some words that stand in a text " * 20, "a", "日本x𓀀 ok " * 9]
    got = lat.sample(texts, np.arange(3), 3)
    assert sum(seen) <= 3 * (1 + 2 + 3)
    for text, own in zip(texts, got, strict=True):
        assert all(lat.decode(s[0]) == text for s in own) and len({tuple(s[0].tolist()) for s in own}) == len(own) and [s[2] for s in own] == sorted((s[2] for s in own), reverse=True)


def test_segment_columns(spark):
    df = spark.createDataFrame([(1, "the cat", "own", 2), (1, "the cat", "own", 2)], "doc_id long, text string, samples string, ids int").withColumn("x.y", F.lit(1))
    found = segment_sampling.sample_segmentations(df, P.path("piece_bpe_32k.model"))
    assert found.columns == ["doc_id", "text", "ids", "x.y", "samples"]
    a, b = segment_sampling.shown(found).collect()
    assert a == b and a.n_samples == 2 and a.text == "the cat" and all(a.decoded)


# ---- all


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import compare

    got, exp = queries.QUERIES[name](spark, SF).toPandas(), compare.oracle(SF).sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(exp.columns) and compare.rows(got) == compare.rows(exp)
