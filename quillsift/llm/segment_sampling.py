"""Distinct sampled SentencePiece segmentations: Gumbel top-k without replacement by perturbed A-star over the lattice.

A text's lattice has an arc for each vocabulary piece at each place (and the bytes of a character that isn't a piece). Its arcs
have log-weights theta * log p(piece); p falls with the piece's rank in the vocabulary, as merge ranks are all that a BPE model
holds. Sums from the right over the lattice give each arc's probability at its place, so a path's probability is a product.

A search node is a set of paths with one beginning; its priority is the largest Gumbel-perturbed log-probability in it, drawn
from its mass and truncated at its parent's. The best node is popped, its best path followed to the end (of which the
remaining choices are drawn from the arc probabilities), and all choices passed by become nodes with truncated priorities.
Paths come out in order of perturbed log-probability without repetition; the priority left on top after k pops is the
threshold kappa, and a path's inclusion score is log(1 - exp(-exp(logp - kappa))). Random numbers are hashes of the seed, the
row key, the pop and the place, so batches and retries don't matter.

Pieces don't cross the start of a run of spaces, so lattices are cut there into chunks; equal chunks of a slice are computed once,
and all steps run over whole slices of texts in numpy.

Nulls and empty texts: no samples (empty arrays). A null row key counts as 0. Very long texts: whole texts, up to SLICE_CHARS of
them (or one) at a time. Ties: equal keys and texts have equal samples; ties of priorities go to the earlier pop and place.
A text with fewer than k segmentations gives all it has, with inclusion score 0 (certain). Empty tables give no rows.
U+2581 in a text is a space to SentencePiece, and decodes as one (decoded is then false). Extra columns pass through; one with the name
of a new column is replaced. Repeated rows have equal samples, each row its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IntTable, free_names, give_back, mix64, named, pa_schema, passing, plain, small_batches, text_bytes

SPACE = "▁"
SLICE_CHARS = 120_000
#: Rows (places of distinct chunks) that a task remembers: 16 arcs of 6 bytes each.
HELD_ROWS, SLOT_BITS = 1_200_000, 20
_M = np.uint64(0x9E3779B97F4A7C15)
_NEVER = -np.inf


@lru_cache(maxsize=2)
def lattice_of(path: str, theta: float) -> Lattice:
    return Lattice(path, theta)


class Lattice:
    """A SentencePiece model as arrays: pieces by hash, with weights."""

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int64)
        usable = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and (len(p) == 1 or sp.get_score(i) > -1e8):  # below that merges never make it
                usable.append(i)
        if any(SPACE in pieces[i].lstrip(SPACE) for i in usable) or any(pieces[i][:2] == SPACE * 2 and pieces[i].strip(SPACE) for i in usable):
            raise ValueError("a piece crosses the start of a run of spaces")
        self.pieces, self.ids = pieces, np.array(usable, np.int64)
        rank = np.array([-sp.get_score(i) for i in usable])
        rank = np.argsort(np.argsort(rank, kind="stable"), kind="stable") + 2.0
        self.log = theta * -np.log(rank * np.sum(1 / rank))
        self.log_byte = theta * -np.log((len(usable) + 2.0) * np.sum(1 / rank))
        self.most = max(len(pieces[i]) for i in usable)
        # hashes of all beginnings of pieces: which piece one is, -1 if it only begins longer ones
        known: dict[int, int] = {}
        for at, i in enumerate(usable):
            h = np.zeros(1, np.uint64)
            for c in pieces[i]:
                h = self._step(h, np.array([ord(c)], np.uint64))
                known.setdefault(int(h[0]), -1)
            known[int(h[0])] = at
        self.table, self.begins = IntTable(np.array(list(known), np.uint64).view(np.int64)), np.array(list(known.values()), np.int64)
        self.used, self.held = 0, None
        self.kind = np.dtype(np.uint16 if n < 65_535 else np.int32)  # of piece numbers; the largest stands for bytes
        self.none = np.iinfo(self.kind).max
        own = {int(b): bytes([i]) for i, b in enumerate(self.bytes) if b >= 0}
        self.piece_bytes = pa.array([own[i] if i in own else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)], pa.binary())

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(31))) * _M + c + np.uint64(1)

    def forget(self) -> None:
        """Gives back the store: the worker may serve other stages next."""
        self.used, self.held, self.names, self.rows = 0, None, None, None

    def rows_of(self, names: np.ndarray, sizes: np.ndarray, starts: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """The first row of each chunk in self.held. Chunks that aren't remembered (one name a slot) are computed; a full store starts
        anew."""
        slot = (names >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        for _ in range(2):
            if self.held is None:
                rows = min(HELD_ROWS, max(4096, 64 * int(sizes.sum())))  # small inputs need a small one
                self.held = (np.empty((rows, self.most), self.kind), np.empty((rows, self.most), np.float32))
            if self.used == 0:
                self.names, self.rows = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int64)
            at = np.where(self.names[slot] == names, self.rows[slot], -1)
            miss = np.flatnonzero(at < 0)
            if not len(miss):
                return at
            _, first, which = np.unique(names[miss], return_index=True, return_inverse=True)
            own = sizes[miss[first]]
            if self.used + int(own.sum()) <= len(self.held[0]):
                break
            self.used = 0
            if int(own.sum()) > len(self.held[0]):  # a chunk or slice larger than the store
                self.held = tuple(np.empty((2 * int(own.sum()), self.most), x.dtype) for x in self.held)
        order = np.argsort(-own, kind="stable")
        new, own = miss[first[order]], own[order]
        start = np.cumsum(own) - own
        to = self.used + int(own.sum())
        self._arcs(starts[new], own, start, cp, *(store[self.used : to] for store in self.held))
        rows = np.empty(len(order), np.int64)
        rows[order] = self.used + start
        at[miss] = rows[which]
        self.names[slot[miss]], self.rows[slot[miss]] = names[miss], at[miss]
        self.used = to
        return at

    def _arcs(self, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, cp: np.ndarray, pieces: np.ndarray, probs: np.ndarray) -> None:
        """Of chunks in order of falling size: piece and probability by row (place, chunk after chunk) and arc length, into pieces and probs.

        Inside, rows stand by their distance t from the chunk's end, so that a step of the sums from the right is a slice."""
        m, rows, longest = self.most, int(sizes.sum()), int(sizes[0])
        count = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        off = np.concatenate([[0], np.cumsum(count)])
        left = np.repeat(np.arange(1, longest + 1), count)
        src = (starts + sizes)[np.arange(rows) - np.repeat(off[:-1], count)] - left
        weight, piece = np.full((m, rows), _NEVER), np.full((m, rows), self.none, self.kind)
        live, h = np.arange(rows), np.zeros(rows, np.uint64)
        for step in range(m):
            h = self._step(h, cp[src[live] + step])
            found = self.table.find(h.view(np.int64))
            which = np.where(found >= 0, self.begins[found], -1)
            hit = which >= 0
            r = live[hit]
            weight[step, r], piece[step, r] = self.log[which[hit]], self.ids[which[hit]]
            if step == 0:
                odd = live[~hit]
                width = 1 + (cp[src[odd]] > 0x7F) + (cp[src[odd]] > 0x7FF) + (cp[src[odd]] > 0xFFFF).astype(np.int64)
                weight[0, odd] = self.log_byte * width
            on = (found >= 0) & (left[live] > step + 1)
            live, h = live[on], h[on]
            if not len(live):
                break
        m = step + 1
        beta, prob = np.zeros(rows), np.zeros((self.most, rows), np.float32)
        for t in range(1, longest + 1):
            n, at = count[t - 1], off[t - 1]
            w = weight[: min(t, m), at : at + n]
            for reach in range(1, min(t - 1, m) + 1):
                w[reach - 1] += beta[off[t - 1 - reach] : off[t - 1 - reach] + n]
            top = w.max(0)
            w -= top
            np.exp(w, out=w)
            total = w.sum(0)
            prob[: min(t, m), at : at + n] = w / total
            beta[at : at + n] = top + np.log(total)
        place = np.arange(rows) - np.repeat(first, sizes)
        order = off[np.repeat(sizes, sizes) - place - 1] + np.repeat(np.arange(len(sizes)), sizes)
        for own, out in ((piece, pieces), (prob, probs)):
            np.take(np.ascontiguousarray(own.T), order, axis=0, out=out, mode="clip")  # places are in range; checking them would cost a copy

    def decode(self, ids) -> str:
        return b"".join(self.piece_bytes.take(pa.array(ids, pa.int32())).to_pylist()).decode("utf-8", "replace")[1:]

    def sample(self, texts: list[str], keys: np.ndarray, k: int, seed: int = 0) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k of (ids, log-probability, perturbed log-probability, log inclusion score), best first."""
        some = [i for i, t in enumerate(texts) if t]
        out: list[list] = [[] for _ in texts]
        if some:
            for i, got in zip(some, _Slice(self, [texts[i] for i in some], keys[some], seed).run(k), strict=True):
                out[i] = got
        return out


class _Slice:
    def __init__(self, lattice: Lattice, texts: list[str], keys: np.ndarray, seed: int):
        self.lat = lattice
        own = [(SPACE + t).replace(" ", SPACE) for t in texts]
        self.cp = cp = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(cp)
        self.doc = np.concatenate([[0], np.cumsum([len(t) for t in own])])
        self.doc_of = np.repeat(np.arange(len(texts)), np.diff(self.doc))
        self.key = mix64(keys.astype(np.int64).view(np.uint64) + mix64(np.array([seed], np.int64).view(np.uint64) + _M))
        # chunks: they start where a run of spaces does, and at each text
        blank = cp == np.uint64(ord(SPACE))
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[self.doc[:-1]] = True
        self.starts = s = np.flatnonzero(start)
        size = np.diff(np.append(s, n))
        self.end = np.repeat(s + size, size)  # of each place's chunk
        # equal chunks share their lattice
        power = np.cumprod(np.full(int(size.max()), _M | np.uint64(1)))
        h = np.add.reduceat((cp + np.uint64(7)) * power[np.arange(n) - np.repeat(s, size)], s) ^ mix64(size.astype(np.uint64))
        at = lattice.rows_of(mix64(h), size, s, cp)
        self.piece, self.prob = lattice.held
        self.flat_piece, self.flat_prob, self.wide = self.piece.ravel(), self.prob.ravel(), self.prob.shape[1]
        self.salt = self.key - self.doc[:-1].astype(np.uint64) * _M
        self.row = np.repeat(at, size) + np.arange(n) - np.repeat(s, size)

    def _unit(self, places: np.ndarray, docs: np.ndarray, pop: int, kind: int) -> np.ndarray:
        """Uniform numbers in (0, 1) for (row key, place in the text, pop, kind)."""
        x = mix64(self.key[docs] + mix64((places - self.doc[docs]).astype(np.uint64) * np.uint64(4096) + np.uint64(pop * 4 + kind + 1)))
        return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52

    def _halves(self, places: np.ndarray, docs: np.ndarray, pop: int) -> np.ndarray:
        """64 bits for (row key, place, pop): the upper half draws the arc at the place, the lower one the node beside it."""
        return mix64(self.salt[docs] + places.astype(np.uint64) * _M + np.uint64(pop * 0xD6E8FEB86659FD93 % 2**64))

    def _follow(self, length: np.ndarray, bits: np.ndarray, places: np.ndarray, pop: int) -> None:
        """Draws arcs from each place to its chunk's end; keeps the bits of the places it comes by."""
        while len(places):
            at = self.row[places] * self.wide
            bits[places] = half = self._halves(places, self.doc_of[places], pop)
            u = ((half >> np.uint64(32)).astype(np.float64) + 0.5) * ((1 - 1e-6) / 2.0**32)
            arc, more, sums = np.zeros(len(places), np.int64), None, np.zeros(len(places))
            for i in range(self.wide - 1):
                sums += self.flat_prob[at]
                on = np.flatnonzero(sums <= u)
                if not len(on):
                    break
                more = on if more is None else more[on]
                at, sums, u = at[on] + 1, sums[on], u[on]
                arc[more] = i + 1
            length[places] = arc + 1
            end = self.end[places]
            places = places + arc + 1
            places = places[places < end]

    def _truncated(self, gumbel: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Gumbel maxima of nodes, truncated at `top`. It rises with the maximum, so the best node of a path is known before."""
        return -np.logaddexp(-top, -gumbel)

    def run(self, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        docs = len(self.doc) - 1
        n = len(self.cp)
        paths, spent = [], [dict() for _ in range(docs)]  # spent: arcs already taken at (path, place)
        found: list[list] = [[] for _ in range(docs)]
        # the first path: the root's priority is a Gumbel of mass 1
        value = -np.log(-np.log(self._unit(self.doc[:-1], np.arange(docs), 0, 1)))
        length = np.zeros(n, np.uint8)
        bits = np.zeros(n, np.uint64)
        self._follow(length, bits, self.starts, 0)
        branch, old = self.doc[:-1].copy(), []  # places from `branch` on are new; old: log-probabilities of those before
        alive = np.ones(docs, bool)
        for pop in range(k):
            steps = np.flatnonzero(length)
            bound = np.searchsorted(steps, self.doc)
            sizes = np.diff(bound)
            arc = self.row[steps] * self.wide + length[steps] - 1
            new = np.flatnonzero(steps >= np.repeat(branch, sizes)) if pop else slice(None)
            fresh, c = steps[new], arc[new]
            p = self.flat_prob[c].astype(np.float64)
            others = 1 - p  # the mass of the other arcs; where it would cancel, summed
            if len(sharp := np.flatnonzero(p > 0.99)):
                r = c[sharp] // self.wide
                beside = self.prob[r]
                beside[np.arange(len(sharp)), c[sharp] - r * self.wide] = 0
                others[sharp] = beside.sum(1)
            if pop:
                lp = np.concatenate(old) if old else np.empty(0)
                whole = np.empty(len(steps))
                is_old = np.ones(len(steps), bool)
                is_old[new] = False
                whole[is_old], whole[new] = lp, np.log(p)
                lp = whole
            else:
                lp = np.log(p)
            total = np.cumsum(lp)
            base = np.where(bound[:-1] > 0, total[np.maximum(bound[:-1] - 1, 0)], 0.0)
            before = total - lp - np.repeat(base, sizes)
            node = np.full(len(steps), _NEVER)  # not truncated: see above
            with np.errstate(divide="ignore"):
                u = ((bits[fresh] & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2.0**32
                node[new] = before[new] + np.log(others / -np.log(u))
            pieces = self.flat_piece[arc].astype(np.int32)
            pieces[pieces == self.lat.none] = -1  # a character as bytes
            live = np.flatnonzero(alive)
            left = self._unit(branch[live], live, pop, 2).tolist() if pop else []
            for i, d in enumerate(live.tolist()):
                lo, hi = bound[d], bound[d + 1]
                found[d].append([self._ids(steps[lo:hi], pieces[lo:hi]), float(total[hi - 1] - base[d]), float(value[d])])
                if pop:  # what is left at the branching place
                    j, taken = int(branch[d]), spent[d][pop]
                    at = lo + int(np.searchsorted(steps[lo:hi], j))
                    p = self.prob[self.row[j]].astype(np.float64)
                    p[taken] = 0
                    mass = float(p.sum())
                    node[at] = before[at] + math.log(mass / -math.log(left[i])) if mass > 0 else _NEVER
            paths.append((length, steps, bound, node, lp, value))
            # the next pop of each text; a text that is done has no path
            best = np.stack([self._truncated(np.array([node[bound[d] : bound[d + 1]].max(initial=_NEVER) for d in range(docs)]) if np.diff(bound).min() == 0 else np.maximum.reduceat(node, bound[:-1]), top) for _, _, bound, node, _, top in paths])
            on = np.argmax(best, 0)
            value = best[on, np.arange(docs)]
            alive &= value > _NEVER
            if pop == k - 1 or not alive.any():
                break
            length, branch, old = np.zeros(n, np.uint8), np.full(docs, n), []
            live, ats = np.flatnonzero(alive), []
            for d in live.tolist():
                _, steps, bound, node, _, _ = paths[on[d]]
                ats.append(int(bound[d]) + int(np.argmax(node[bound[d] : bound[d + 1]])))
                branch[d] = steps[ats[-1]]
            drawn = self._unit(branch[live], live, pop + 1, 3).tolist()
            open_places = []
            for d, at, j, u in zip(live.tolist(), ats, branch[live].tolist(), drawn, strict=True):
                a, lo, hi = int(on[d]), int(self.doc[d]), int(self.doc[d + 1])
                taken_length, _, bound, node, lp, _ = paths[a]
                node[at] = _NEVER
                taken = spent[d].get(a, []) if a and self._branched(spent[d], a, j) else [int(taken_length[j]) - 1]
                p = self.prob[self.row[j]].astype(np.float64)
                p[taken] = 0
                c = np.cumsum(p)
                arc = int(np.searchsorted(c, c[-1] * u * (1 - 1e-9), side="right"))
                spent[d][pop + 1], spent[d][-pop - 1] = [*taken, arc], j
                length[lo:j] = taken_length[lo:j]
                old.append(lp[bound[d] : at])
                length[j] = arc + 1
                if j + arc + 1 < self.end[j]:
                    open_places.append(np.array([j + arc + 1]))
                open_places.append(self.starts[np.searchsorted(self.starts, j + 1) : np.searchsorted(self.starts, hi)])
            self._follow(length, bits, np.concatenate(open_places), pop + 1)
        kappa = best.max(0)
        return [[(ids, lp, g, self._inclusion(lp, kappa[d])) for ids, lp, g in found[d]] for d in range(docs)]

    @staticmethod
    def _branched(spent: dict, path: int, place: int) -> bool:
        return spent.get(-path) == place

    @staticmethod
    def _inclusion(lp: float, kappa: float) -> float:
        x = lp - kappa
        return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 50.0)))))

    def _ids(self, steps: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        if not len(odd := np.flatnonzero(pieces < 0)):
            return pieces
        if (ascii := self.cp[steps[odd]]).max() < 128:
            pieces[odd] = self.lat.bytes[ascii.astype(np.int64)]
            return pieces
        out = []
        for s, i in zip(steps.tolist(), pieces.tolist(), strict=True):
            out += [i] if i >= 0 else self.lat.bytes[list(chr(int(self.cp[s])).encode("utf-8", "surrogatepass"))].tolist()
        return np.array(out, np.int32)


def ids_digest(ids: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(ids.astype("<i4").tobytes())


def _arrays(found: list[list], texts: pa.Array, lat: Lattice, kind: pa.ListType) -> pa.Array:
    """Samples of a slice as an array of `kind`, without a Python object an id; what the ids decode to is compared with the texts' bytes."""
    every = [x for own in found for x in own]
    sizes = np.array([len(x[0]) for x in every], np.int64)
    flat = np.concatenate([x[0] for x in every]).astype(np.int32) if every else np.empty(0, np.int32)
    to = np.concatenate([[0], np.cumsum(sizes)])
    said = lat.piece_bytes.take(pa.array(flat))
    _, at, data = said.buffers()
    at = np.frombuffer(at, np.int32)[said.offset : said.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    raw, offs = text_bytes(texts)
    decoded, sample = [], 0
    for i, own in enumerate(found):
        text = raw[offs[i] : offs[i + 1]]
        for _ in own:
            lo, hi = at[to[sample]], at[to[sample + 1]]
            decoded.append(hi - lo == len(text) + 1 and data[lo] == 0x20 and np.array_equal(data[lo + 1 : hi], text))
            sample += 1
    struct = kind.value_type
    ids = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(flat), type=struct.field("ids").type)
    columns = [ids, pa.array([ids_digest(x[0]) for x in every], pa.string()), pa.array(decoded, pa.bool_()), *(pa.array([x[i] for x in every], pa.float64()) for i in (1, 2, 3))]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(struct)), type=kind)


def sample_segmentations(docs: DataFrame, path: str, *, k: int = 2, theta: float = 1.0, seed: int = 0, key_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or its `columns`) with samples: array of (ids, ids_digest, decoded: whether the ids decode to the text, logp, perturbed,
    log_inclusion), best perturbed first. path: the model, which each executor must have."""
    keep, schema = passing(docs, columns, "samples array<struct<ids:array<int>,ids_digest:string,decoded:boolean,logp:double,perturbed:double,log_inclusion:double>>")
    text, key = free_names(docs, "text", "key")
    out = pa_schema(docs.sparkSession, schema)
    small_batches(docs.sparkSession)

    def run(batches):
        lat = lattice_of(path, theta)
        for batch in batches:
            texts, keys = batch.column(len(keep)).to_pylist(), np.array([x or 0 for x in batch.column(len(keep) + 1).to_pylist()], np.int64)
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE_CHARS):
                    size += len(texts[to] or "")
                    to += 1
                part = batch.slice(at, to - at)
                found = lat.sample([t or "" for t in texts[at:to]], keys[at:to], k, seed)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), _arrays(found, part.column(len(keep)), lat, out.field("samples").type)], schema=out)
                at = to
        lat.forget()
        give_back()

    return plain(docs.select(*map(named, keep), F.col(text_col).alias(text), F.col(key_col).cast("long").alias(key))).mapInArrow(run, schema)


#: Columns of shown(), after those that are kept.
SHOWN = ("n_samples", "ids", "n_pieces", "ids_digest", "decoded", "logp", "perturbed", "log_inclusion")


def shown(found: DataFrame) -> DataFrame:
    """sample_segmentations() with n_samples, and arrays of one entry a sample: ids, n_pieces, ids_digest, decoded, logp, perturbed,
    log_inclusion. Other columns with these names are replaced."""
    keep = [c for c in found.columns if c != "samples" and c.lower() not in SHOWN]
    more = {"n_samples": F.size("samples"), "n_pieces": F.transform("samples.ids", F.size)}
    return found.select(*map(named, keep), *[more.get(c, F.col(f"samples.{c}")).alias(c) for c in SHOWN])


def decoder(path: str) -> Callable[[list[int]], str]:
    return lattice_of(path, 1.0).decode
