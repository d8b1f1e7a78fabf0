"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

A text is cut at the special tokens (one token each) and then into pre-tokens. Pre-tokens not seen before by the task wait in a
batch: their byte symbols lie in one flat array with a sequence number each. In a round, every sequence finds the lowest
rank among its pairs and all its places of that pair merge at once (of overlapping places, every second from the left);
sequences without a ranked pair leave the arrays, and the symbols they end with are counted. Texts are sums over pre-tokens.

Nulls and empty texts: 0 bytes, 0 tokens. Very long texts: whole texts; a batch is merged whenever BATCH_BYTES wait.
Ties (equal pairs in a sequence) merge in one round; repeated rows count alike; empty tables give no rows.
Other columns pass through; one with the name of a new column is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IntTable, free_names, map_batches, named, passing

#: Pre-tokens that a task remembers before it starts anew, and bytes of new ones that it merges at once.
CACHE_TOKENS, BATCH_BYTES = 400_000, 2_000_000
_NONE = np.int64(2**62)


def byte_alphabet() -> list[str]:
    """The characters that stand for bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, the others from
    U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own, more = dict(zip(shown, map(chr, shown), strict=True)), 0
    for b in range(256):
        if b not in own:
            own[b] = chr(256 + more)
            more += 1
    return [own[b] for b in range(256)]


class RankedPairs:
    """A byte-level BPE file of the tokenizers library as arrays: the ids of bytes, and a table of pairs in the order of their ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without prefix space or normaliser")
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.table, self.made = IntTable(keys), made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE if it has none."""
        found = self.table.find(left << 32 | right)
        return np.where(found < 0, _NONE, found)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols that each byte string ends with."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        out = sizes.copy()
        while len(symbols) > 1:
            inside = owner[:-1] == owner[1:]
            ranks = np.where(inside, self.rank(symbols[:-1], symbols[1:]), _NONE)
            starts = np.flatnonzero(np.concatenate([[True], ~inside]))
            lowest = np.minimum.reduceat(np.append(ranks, _NONE), starts)
            live = lowest < _NONE
            if not live.any():
                break
            seq = np.cumsum(np.concatenate([[0], ~inside]))
            hit = (ranks == lowest[seq[:-1]]) & (ranks < _NONE)
            at = np.flatnonzero(hit)
            # of places that overlap (aaa), every second from the left
            new_run = np.concatenate([[True], np.diff(at) > 1])
            in_run = np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            at = at[in_run % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            stay = live[seq]
            stay[at + 1] = False
            np.subtract.at(out, owner[at], 1) if len(at) < 64 else out.__isub__(np.bincount(owner[at], minlength=len(out)))
            symbols, owner = symbols[stay], owner[stay]
        return out


class TokenCounter:
    """Counts tokens of texts, remembering pre-tokens."""

    def __init__(self, path: str, pattern: str, cache_tokens: int = CACHE_TOKENS):
        self.pairs, self.find, self.seen, self.most = RankedPairs(path), regex.compile(pattern).findall, {}, cache_tokens
        self.special = regex.compile("|".join(regex.escape(s) for s in self.pairs.specials)) if self.pairs.specials else None

    def learn(self, new: Iterable[str]) -> None:
        batch, size = [], 0
        for t in new:
            batch.append(t)
            size += len(t)
            if size >= BATCH_BYTES:
                self._merge(batch)
                batch, size = [], 0
        if batch:
            self._merge(batch)

    def _merge(self, batch: list[str]) -> None:
        self.seen.update(zip(batch, self.pairs.counts([t.encode() for t in batch]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        found, more = [], []
        for text in texts:
            if self.special and (hits := sum(1 for _ in self.special.finditer(text))):
                found.append([t for part in self.special.split(text) for t in self.find(part)])
                more.append(hits)
            else:
                found.append(self.find(text))
                more.append(0)
        if len(self.seen) > self.most:
            self.seen = {}
        new = set()
        for tokens in found:
            new.update(tokens)
        self.learn(t for t in new if t not in self.seen)
        get = self.seen.__getitem__
        return [sum(map(get, tokens)) + k for tokens, k in zip(found, more, strict=True)]


def count_tokens(docs: DataFrame, path: str, pattern: str, *, limit: int = 1024, text_col: str = "text", columns: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or its `columns`) with n_bytes, n_tokens and over_limit (more than `limit` tokens). path: the vocabulary file, which
    each executor must have; pattern: its pre-token pattern."""
    keep, schema = passing(docs, columns, "n_bytes long, n_tokens long, over_limit boolean")
    chosen = docs.select(*map(named, keep), F.col(text_col).alias(*free_names(docs, "text")))

    def make():
        counter = TokenCounter(path, pattern)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            n = counter.count(texts)
            return dict(zip(keep, batch.columns)) | {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return map_batches(chosen, schema, make)
