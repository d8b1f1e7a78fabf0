"""Language identification by multilingual mixture inference.

Model: for each language the counts of hashed character n-grams (1 to 3 over words in lower case with a mark at both ends) of a
bounded sample of labelled texts, smoothed towards all languages together. The sample is what hash(doc_id) picks: about
`sample` documents a language and the `most` most frequent languages, so its size doesn't grow with the corpus.

Prediction: an n-gram of a text is drawn from language l with its proportion p_l. Expectation-maximisation over the text's
distinct n-grams estimates the proportions over all languages; languages are then added in order of proportion, each set
fitted again, as long as the log-likelihood gained exceeds the penalty of a parameter, penalty * log(n). The prediction is the
largest proportion of the chosen set, and the score that proportion times the language's posterior against each other single
language. Only the text is an input.

Nulls: null text is `und` with score 0. Null languages are not learned; null ids are, as crc32 of null is null, held in.
Empty texts and texts without a letter: `und`, 0. Very long texts: whole texts (n-grams are counted, a worker holds one).
Ties go to the language that is first by code point; repeated rows are predicted alike. Empty tables give no rows; without
any labelled row all is `und`. Extra columns pass through; one with the name of a new column is replaced.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, map_batches, named, passing

BUCKETS = 1 << 16
#: Documents a language that the model learns from, about.
SAMPLE = 3000
UND = "und"
#: Languages that a model holds at most: what is sent to each task is 0.5 MB a language, however dirty the labels.
LANGUAGES = 500
#: n-grams overlap, so a text has fewer independent draws than n-grams: their share, for likelihoods.
DRAWS = 0.3


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of orders 1 to 3, below BUCKETS; runs of anything but letters are one mark."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # letters of ASCII, and all beyond it but the punctuation and signs of Latin-1 and U+2000 to U+2BFF
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x2C00))) | (points == 0xAA) | (points == 0xBA) | (points == 0xB5)
    points[~letter] = 1
    first = np.concatenate([[True], ~letter[:-1]])
    points = np.concatenate([[np.uint64(1)], points[letter | ~first], [np.uint64(1)]])
    one = points * np.uint64(0x9E3779B97F4A7C15)
    two = one[:-1] * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
    three = two[:-1] * np.uint64(0x94D049BB133111EB) + one[2:]
    every = np.concatenate([one[1:-1][points[1:-1] > 1] ^ np.uint64(1), two ^ np.uint64(2), three ^ np.uint64(3)])
    return (((every ^ (every >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Mixture:
    """Languages with their n-gram probabilities, and the inference of a text's proportions."""

    def __init__(self, langs: list[str], counts: np.ndarray, penalty: float = 4.0, rounds: int = 12):
        self.langs, self.penalty, self.rounds = langs, penalty, rounds
        base = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
        mass = counts.sum(1, keepdims=True)
        self.p = np.ascontiguousarray(((counts + 50.0 * base) / (mass + 50.0)).T.astype(np.float32))  # BUCKETS x languages
        self.log = np.log(self.p)

    def fit(self, p: np.ndarray, c: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """EM from `start`: proportions, and the log-likelihood of the last step but one."""
        share, n, total = start, c.sum(), None
        for _ in range(rounds):
            total = p @ share
            share = share * ((c / total) @ p) / n
        return share, float(c @ np.log(total))

    def infer(self, text: str) -> tuple[str, float, list[tuple[str, float]]]:
        """Language, score, and the chosen languages with their proportions."""
        if not self.langs or not has_letter(text):
            return UND, 0.0, []
        found = grams(text)
        if not len(found):
            return UND, 0.0, []
        at, c = np.unique(found, return_counts=True)
        c = c.astype(np.float32) * np.float32(DRAWS)
        single = c @ self.log[at]
        k = len(self.langs)
        posterior = np.exp(single - single.max())
        posterior /= posterior.sum()
        best = int(np.argmax(single))
        chosen, share = [best], np.ones(1)
        if k > 1:
            p = self.p[at]
            every, _ = self.fit(p, c, np.full(k, 1 / k, np.float32), self.rounds)
            order = np.argsort(-every, kind="stable")
            likelihood = float(single[best])
            for size in range(2, k + 1):
                own = sorted(order[:size].tolist())
                got, now = self.fit(np.ascontiguousarray(p[:, own]), c, every[own] / every[own].sum(), self.rounds)
                if now - likelihood <= self.penalty * np.log(c.sum() + 1):
                    break
                chosen, share, likelihood = own, got / got.sum(), now
        top = int(np.argmax(share))
        score = float(share[top]) * (float(posterior[chosen[top]]) if len(chosen) == 1 else 1.0)
        return self.langs[chosen[top]], min(1.0, max(0.0, score)), sorted(((self.langs[i], float(s)) for i, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, penalty: float = 4.0, most: int = LANGUAGES) -> Mixture:
    """The mixture of the languages of labelled: the `most` most frequent ones (rows with null text or language are ignored)."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    many = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    langs = sorted(many)
    if not langs:
        return Mixture([], np.ones((1, BUCKETS)), penalty)
    spot = (F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(1_000_000)) / 1e6)
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / many[lang]))]), F.col(lang_col))
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), BUCKETS))
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[place[lang]] += np.bincount(grams(text), minlength=BUCKETS)
        row, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[row, at])], names=["lang", "gram", "n"])

    parts = rows.where(F.col(lang_col).isin(langs) & (spot < share)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang int, gram int, n double")
    counts = np.zeros((len(langs), BUCKETS))  # languages x BUCKETS at most, however large the corpus
    table = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts[table["lang"].to_numpy(), table["gram"].to_numpy()] = table["n"].to_numpy()
    return Mixture(langs, counts, penalty)


def identify(docs: DataFrame, model: Mixture, *, text_col: str = "text", columns: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or its `columns`) with lang_pred, score, and mixture: the chosen languages with their proportions, largest first."""
    keep, schema = passing(docs, columns, "lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    chosen = docs.select(*map(named, keep), F.col(text_col).alias(*free_names(docs, "text")))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        infer = held.value.infer

        def work(batch: pa.RecordBatch) -> dict:
            found = [infer(t) for t in batch.column(len(keep)).to_pylist()]
            return dict(zip(keep, batch.columns)) | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "mixture": [[{"lang": a, "share": s} for a, s in x[2]] for x in found]}

        return work

    return map_batches(chosen, schema, make)
