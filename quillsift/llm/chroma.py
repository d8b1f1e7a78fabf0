"""Chroma audio fingerprints of a media column, and the alignment of recordings by them.

Media: mono PCM (unsigned 8-bit or signed 16-bit), or text that is played (kind "tones"): each word, lower-cased, is a chord of TONE samples,
three of the twelve semitones from rate / 4 to rate / 2 by its hash, and each line begins at a whole step, so that texts with other words
are the same music beside them, shifted by whole steps.

Fingerprint: the signal is cut into overlapping windowed frames; their power spectra fold into 12 pitch classes, each frame scaled
to length 1. Over the classes-by-time image an integral image makes any rectangle's sum four look-ups; 16 filters (pairs of
rectangles in six shapes, see filters()) compare neighbouring parts of a window of WINDOW frames, each comparison is quantised
to 2 bits (Gray code), and a step in time gives one packed 32-bit integer.

Alignment: recordings with equal integers are one class (its smallest id stands for it); if they have under RUN integers, only
those of equal media are, as so few are too few to tell recordings apart. Runs of RUN consecutive integers are hashed; a class's marks are
all of them (sample=n: its smallest hashes, those in the lowest 1 / n and `least` at least, which judge pairs near the threshold by chance). Two classes are aligned by the offsets of their equal runs (a
run that repeats votes with its first place): of each bin of the offset histogram, fullest first, the stretch from its first to its last vote
counts if the share of bit errors in it is max_ber at most. They are linked if such stretches cover half of the longer one
and they share `shared` per cent of the marks of the one that has more. Linked classes are one component.

Which classes are compared: each with the most central class of the marks it has (a star), and after links are contracted all classes of
different components that share one of their rarest marks, as many as classes can do without and still be linked (prefix and position
filters, as in near_dedup). So no link is lost, no pair is tested whose link could not change a component, and a passage that many
recordings hold makes no pairs by itself, as its marks aren't rare.

Frames of texts that hold the same two chords are transformed once. Integers are made in blocks of BLOCK, so a worker holds a recording's bytes, its integers, and one block. They aren't written:
those that have a mark in common with another are read and printed once more. Marks aren't written either: their first 40 bits go to 512 shards
in compressed blobs (packed_marks()), and what comes out is the marks that several rows have. Marks that differ but begin alike count as one there,
which makes more candidates and no fewer; links are judged by all 64 bits.

Nulls: null media has no integers (n_prints 0), no fingerprint and no match; null ids never stand for a class that has
another id. Empty media: likewise. Recordings shorter than a window are padded with silence to one. Very long recordings: whole.
Ties: the match is the linked class of most votes, then of the smallest id; without a link, the class it was compared with in the star.
Repeated rows get equal results. Empty tables give no rows. Extra columns are ignored; no name can clash.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drop, give_back, map_batches, materialise, mix64, pa_schema, plain, small_batches, sweep, text_bytes, word_hashes, word_starts
from .near_dedup import BROADCAST_IDS, contract, few, rest

CLASSES, WINDOW, RUN, BLOCK = 12, 4, 4, 8192
MAX_BER = 0.2
#: Marks: one run in SAMPLE, LEAST at least. 1: every run, so that no link that meets the threshold is left out.
SAMPLE, LEAST = 1, 24
#: Marks are dealt by their first KEY_BITS bits: to shards, in blobs of one block of rows each. A block has HELD marks, or its rows fill two bytes.
KEY_BITS, SHARD_BITS, HELD, BLOCK_ROWS = 40, 9, 1 << 21, 1 << 16
#: Samples of a word, its chords, and silence.
TONE = 64
CHORDS = tuple(itertools.combinations(range(CLASSES), 3))
REST = len(CHORDS)


def filters() -> list[tuple[list[tuple[int, int, int, int, int]], float]]:
    """16 filters: rectangles (sign, class from, to, frame from, to) and the quantising step. Shapes in turn: low against high
    classes, early against late frames, outer against middle classes, outer against middle frames, diagonal quarters, whole."""
    out = []
    for i in range(16):
        width, height, y = (2, 4)[i % 2], (3, 4, 6, 12)[i // 4], (i * 5) % 12
        h = min(height, CLASSES)
        y = min(y, CLASSES - h)
        hm, wm, ht, wt = y + h // 2, width // 2, h // 3, width // 4
        shape = i % 6
        if shape == 0:
            r = [(1, y, hm, 0, width), (-1, hm, y + h, 0, width)]
        elif shape == 1:
            r = [(1, y, y + h, 0, wm), (-1, y, y + h, wm, width)]
        elif shape == 2:
            r = [(1, y, y + ht, 0, width), (-2, y + ht, y + h - ht, 0, width), (1, y + h - ht, y + h, 0, width)]
        elif shape == 3:
            r = [(1, y, y + h, 0, wt), (-1, y, y + h, wt, width - wt), (1, y, y + h, width - wt, width)]
        elif shape == 4:
            r = [(1, y, hm, 0, wm), (-1, y, hm, wm, width), (-1, hm, y + h, 0, wm), (1, hm, y + h, wm, width)]
        else:
            r = [(1, 0, 6, 0, width), (-1, 6, 12, 0, width)]
        out.append((r, 0.02 * width * h))
    return out


def passed(bound: float) -> float:
    """What a value is over if, rounded to 5 digits, it is over the bound: rounded, so that equal signals at other places have equal integers."""
    k = round(bound * 1e5)
    return (k + (k / 1e5 <= bound) - 0.5) / 1e5


def fold_matrix(rate: int, frame: int, low: float, high: float) -> np.ndarray:
    """frame // 2 + 1 bins by 12 pitch classes."""
    hertz = np.arange(frame // 2 + 1) * rate / frame
    out = np.zeros((len(hertz), CLASSES), np.float32)
    use = np.flatnonzero((hertz >= low) & (hertz <= high))
    out[use, np.round(12 * np.log2(hertz[use] / 440.0)).astype(int) % CLASSES] = 1
    return out


# ---- media: ragged signals, one after the other, each padded with silence to `least` samples


class Pcm:
    def __init__(self, blobs: list[bytes], bits: int, least: int):
        kind, self.zero, self.scale = (np.uint8, 128, 1.0) if bits == 8 else (np.dtype("<i2"), 0, 1 / 256)
        width = bits // 8
        own = [np.frombuffer(b[: len(b) // width * width], kind) for b in blobs]
        self.sizes = np.array([max(len(x), least) if len(x) else 0 for x in own], np.int64)
        silence = np.full(least, self.zero, kind)
        self.signal = np.concatenate([part for x, n in zip(own, self.sizes.tolist(), strict=True) for part in (x, silence[: n - len(x)])]) if own else silence[:0]

    def frames(self, starts: np.ndarray, size: int) -> np.ndarray:
        """len(starts) x size, as float32; starts rise."""
        lo = int(starts[0])
        signal = (self.signal[lo : int(starts[-1]) + size].astype(np.float32) - np.float32(self.zero)) * np.float32(self.scale)
        return np.lib.stride_tricks.sliding_window_view(signal, size)[starts - lo]

    def same(self, starts: np.ndarray, size: int) -> None:
        """Nothing is known about which frames are the same."""


@functools.lru_cache(4)
def tones(rate: int) -> np.ndarray:
    """The samples of each chord, and of silence."""
    hertz = rate / 4 * 2 ** ((np.arange(CLASSES) + 0.5) / CLASSES)
    wave = 100 * np.sin(2 * np.pi * hertz[:, None] * np.arange(TONE) / rate)
    out = np.zeros((REST + 1, TONE), np.float32)
    out[:REST] = wave[np.array(CHORDS)].sum(1)
    return out


class Tones:
    """Texts as chords: one slot of TONE samples a word, and rests before lines that would not begin at a whole step of `slots` slots."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, rate: int, slots: int, least: int):
        at, _ = word_starts(raw, offs)
        hashes, bounds = word_hashes(raw, offs)
        chord = ((hashes >> np.uint64(32)) * np.uint64(REST) >> np.uint64(32)).astype(np.uint8)
        line = np.cumsum(raw == 10)[at] + np.repeat(np.arange(len(offs) - 1), np.diff(bounds)) if len(at) else np.empty(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(at) else np.empty(0, np.int64)
        length = np.diff(np.append(first, len(at)))
        before = np.concatenate([[0], np.cumsum(-length % slots)])  # rests after each line
        slot = np.arange(len(at)) + np.repeat(before[:-1], length)
        words = np.diff(bounds)
        rests = before[np.searchsorted(first, bounds)]
        used = words + np.diff(rests)
        need = np.where(words > 0, np.maximum(used, -(-least // TONE)), 0)
        start = np.concatenate([[0], np.cumsum(need)])
        self.codes = np.full(int(start[-1]), REST, np.uint8)
        self.codes[slot + np.repeat(start[:-1] - bounds[:-1] - rests[:-1], words)] = chord
        self.sizes = need * TONE
        self.tones = tones(rate)

    @classmethod
    def of(cls, slots: list[bytes], rate: int) -> Tones:
        """Of what slots() gave."""
        out = cls.__new__(cls)
        out.codes, out.sizes, out.tones = np.frombuffer(b"".join(slots), np.uint8), np.array([len(x) for x in slots], np.int64) * TONE, tones(rate)
        return out

    def slots(self) -> list[bytes]:
        """The chords of each text, a byte a slot: all that its integers are made of, in a quarter of their bytes."""
        at = np.concatenate([[0], np.cumsum(self.sizes // TONE)]).tolist()
        return [self.codes[lo:hi].tobytes() for lo, hi in itertools.pairwise(at)]

    def frames(self, starts: np.ndarray, size: int) -> np.ndarray:
        """len(starts) x size, as float32; starts and size are whole slots."""
        return self.tones[self.codes[starts[:, None] // TONE + np.arange(size // TONE)]].reshape(len(starts), size)

    def same(self, starts: np.ndarray, size: int) -> np.ndarray | None:
        """A number for each frame of two chords, equal for frames that are the same; below (REST + 1) ** 2."""
        slot = starts // TONE
        return self.codes[slot].astype(np.int64) * (REST + 1) + self.codes[slot + 1] if size == 2 * TONE else None


class Printer:
    def __init__(self, rate: int, frame: int, hop: int, low: float, high: float):
        self.rate, self.frame, self.hop, self.least = rate, frame, hop, frame + (WINDOW - 1) * hop
        self.window, self.fold, self.filters = np.hanning(frame).astype(np.float32), fold_matrix(rate, frame, low, high), [(parts, tuple(map(passed, (-step, 0.0, step)))) for parts, step in filters()]
        self.known, self.rows = np.full((REST + 1) ** 2, -1, np.int64), np.empty((0, CLASSES), np.float32)
        self.room = np.zeros((CLASSES + 1, 0))

    def image(self, media: Pcm | Tones, starts: np.ndarray) -> np.ndarray:
        """The pitch classes of the frames at rising starts: len(starts) x 12. Frames known to be the same are transformed once."""
        same = media.same(starts, self.frame)
        if same is None:
            return self.chroma(media.frames(starts, self.frame))
        if len(missing := np.flatnonzero(self.known[same] < 0)):
            new, first = np.unique(same[missing], return_index=True)
            self.known[new] = len(self.rows) + np.arange(len(new))
            self.rows = np.concatenate([self.rows, self.chroma(media.frames(starts[missing[first]], self.frame))])
        return self.rows[self.known[same]]

    def chroma(self, frames: np.ndarray) -> np.ndarray:
        """The pitch classes of float32 frames."""
        s = np.fft.rfft(frames * self.window)
        out = (s.real**2 + s.imag**2).astype(np.float32) @ self.fold
        length = np.sqrt((out**2).sum(1, keepdims=True))
        return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-3)

    def packed(self, image: np.ndarray) -> np.ndarray:
        """The integers at the frames of an image at which a window begins, by its integral image: each filter is a few sums of
        shifted columns."""
        n = len(image) - WINDOW + 1
        if self.room.shape[1] <= len(image):
            self.room = np.zeros((CLASSES + 1, len(image) + 1))
        total = self.room[:, : len(image) + 1]  # its first row and column stay 0
        columns = image.T.astype(np.float64, order="C")
        for y in range(CLASSES):
            if y:
                columns[y] += columns[y - 1]
            np.cumsum(columns[y], out=total[y + 1, 1:])
        out, rows = np.zeros((4, n), np.uint8), {}
        for i, (parts, (low, middle, high)) in enumerate(self.filters):
            value = None
            for sign, y0, y1, x0, x1 in parts:
                if (y0, y1) not in rows:
                    rows[y0, y1] = total[y1] - total[y0]
                part = rows[y0, y1][x1 : x1 + n] - rows[y0, y1][x0 : x0 + n]
                if abs(sign) != 1:
                    part *= abs(sign)
                value = part if value is None else np.add(value, part, out=value) if sign > 0 else np.subtract(value, part, out=value)
            # Gray code of the number of bounds that are passed, which come in the order of low, middle, high
            byte = out[3 - i // 4]
            byte <<= 1
            byte |= (value > middle).view(np.uint8)
            byte <<= 1
            byte |= ((value > low) ^ (value > high)).view(np.uint8)
        return out.T.copy().view("<u4").ravel().astype(np.uint32, copy=False)

    def prints(self, media: Pcm | Tones) -> list[np.ndarray]:
        """The packed integers (uint32) of each recording; none for an empty one."""
        start = np.concatenate([[0], np.cumsum(media.sizes)])[:-1]
        n = np.where(media.sizes > 0, (media.sizes - self.least) // self.hop + 1, 0)
        pieces = [(r, at, min(BLOCK, n[r] - at)) for r in np.flatnonzero(n).tolist() for at in range(0, int(n[r]), BLOCK)]
        out, i = [], 0
        while i < len(pieces):
            j, size = i, 0
            while j < len(pieces) and (j == i or size + pieces[j][2] <= BLOCK):
                size += pieces[j][2]
                j += 1
            r, at, m = (np.array(x, np.int64) for x in zip(*pieces[i:j], strict=True))
            frames = m + WINDOW - 1
            first = np.cumsum(frames) - frames
            starts = np.repeat(start[r] + at * self.hop, frames) + (np.arange(frames.sum()) - np.repeat(first, frames)) * self.hop
            out.append(self.packed(self.image(media, starts))[np.repeat(first, m) + np.arange(size) - np.repeat(np.cumsum(m) - m, m)])
            i = j
        return np.split(np.concatenate(out) if out else np.empty(0, np.uint32), np.cumsum(n)[:-1])


# ---- runs, marks, and the alignment of two recordings


def runs(p: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN consecutive integers."""
    x = p.view(np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(x) - RUN + 1), np.uint64)
    for j in range(RUN):
        h = mix64(h * np.uint64(31) + x[j : j + len(h)] + np.uint64(j + 1))
    return h


def marks(distinct: np.ndarray, sample: int = SAMPLE, least: int = LEAST) -> np.ndarray:
    """The smallest of sorted distinct hashes: those in the lowest 1 / sample, `least` at least."""
    below = len(distinct) if sample == 1 else int(np.searchsorted(distinct, np.uint64(2**64 // sample)))
    return distinct[: max(below, least)]


def first_runs(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of runs, sorted, and the first place of each."""
    h = runs(p)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    return h[first], order[first]


def align(x: np.ndarray, y: np.ndarray, max_ber: float, per_cent: int, sample: int = SAMPLE, least: int = LEAST, of_y: tuple | None = None) -> dict | None:
    """How two recordings align; x[i] stands beside y[i + offset]. None if they have no run in common. shared: the votes of the fullest bin with a
    stretch that counts, overlap and bit_errors: of that stretch; without one, those of the fullest bin. of_y: first_runs(y), if they are known."""
    ux, ix = first_runs(x)
    uy, iy = first_runs(y) if of_y is None else of_y
    b = np.searchsorted(uy, ux)
    a = np.flatnonzero(np.append(uy, np.uint64(0))[b] == ux) if len(uy) else np.empty(0, np.int64)
    a = a[b[a] < len(uy)]
    b = b[a]
    if not len(a):
        return None
    px, offset = ix[a], iy[b] - ix[a]
    bins, which, votes = np.unique(offset, return_inverse=True, return_counts=True)
    by_bin = np.split(px[np.argsort(which, kind="stable")], np.cumsum(votes)[:-1])
    in_x, in_y, best, fullest = np.zeros(len(x), bool), np.zeros(len(y), bool), None, None
    for k in np.lexsort((bins, -votes)).tolist():
        o, lo, hi = int(bins[k]), int(by_bin[k].min()), int(by_bin[k].max()) + RUN
        if in_x[lo:hi].all():
            continue
        errors = int(np.bitwise_count(x[lo:hi] ^ y[lo + o : hi + o]).sum())
        found = {"shared": int(votes[k]), "offset": o, "overlap": hi - lo, "bit_errors": errors}
        fullest = fullest or found
        if errors <= max_ber * 32 * (hi - lo):
            best = best or found
            in_x[lo:hi] = in_y[lo + o : hi + o] = True
    mx, my = marks(ux, sample, least), marks(uy, sample, least)
    both = len(a) if len(mx) == len(ux) and len(my) == len(uy) else len(np.intersect1d(mx, my, assume_unique=True))
    linked = 2 * min(in_x.sum(), in_y.sum()) >= max(len(x), len(y)) and 100 * both >= per_cent * max(len(mx), len(my))
    return (best or fullest) | {"linked": bool(linked)}


# ---- marks on their way to those they may be equal to


def packed_marks(found: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(shard, blob) of the first KEY_BITS bits of the marks of each of the rows of a block: gaps of the sorted keys and numbers of rows, byte by
    byte, compressed. About 4 bytes a mark."""
    flat = np.concatenate(found)
    row = np.repeat(np.arange(len(found), dtype=np.uint64), [len(x) for x in found])
    flat = np.sort(flat >> np.uint64(64 - KEY_BITS) << np.uint64(64 - KEY_BITS) | row)
    bounds = np.searchsorted(flat, np.arange(1 << SHARD_BITS, dtype=np.uint64) << np.uint64(64 - SHARD_BITS)).tolist() + [len(flat)]
    key = (flat << np.uint64(SHARD_BITS) >> np.uint64(64 - KEY_BITS + SHARD_BITS)).astype(np.uint32)
    planes = np.diff(key, prepend=key[:1]).view(np.uint8).reshape(-1, 4)
    rows = flat.astype(np.uint16).view(np.uint8).reshape(-1, 2)
    out = []
    for shard, (lo, hi) in enumerate(itertools.pairwise(bounds)):
        if lo < hi:
            first = key[lo : lo + 1].view(np.uint8)
            own = np.concatenate([planes[lo:hi].T.ravel(), rows[lo:hi].T.ravel()])
            own[: 4 * (hi - lo) : hi - lo] = first  # the first gap is from the shard's start
            out.append((shard, (hi - lo).to_bytes(4, "little") + pa.compress(own, "zstd", asbytes=True)))
    return out


def unpacked_marks(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a blob within its shard, sorted, and the number of each one's row in its block."""
    n = int.from_bytes(blob[:4], "little")
    own = np.frombuffer(pa.decompress(blob[4:], 6 * n, "zstd", asbytes=True), np.uint8)
    gaps = np.ascontiguousarray(own[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(gaps, dtype=np.uint32), np.ascontiguousarray(own[4 * n :].reshape(2, n).T).view(np.uint16).ravel()


def shared_keys(shard: int, blocks: list[int], blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the marks of a shard that several rows have. A row's marks with the same first bits count apart, as first, second, ..., so
    that two rows have as many keys in common as marks at least."""
    parts = [unpacked_marks(b) for b in blobs]
    key = np.concatenate([k for k, _ in parts])
    row = np.concatenate([r.astype(np.int64) + (b * BLOCK_ROWS) for b, (_, r) in zip(blocks, parts, strict=True)])
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    key, row = key[again].astype(np.int64), row[order[again]]
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])[: len(key)]
    at = np.flatnonzero(first)
    nth = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    # rows, not marks, that have the key: of one row's own marks none is shared
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]) - 1
    several = np.bincount(group, first)[group] > 1 if len(key) else np.empty(0, bool)
    return row[several], (((np.int64(shard) << (KEY_BITS - SHARD_BITS)) + key) << 23 | nth)[several]


def _marked(media: DataFrame, how: dict, id_col: str, media_col: str, sample: int, least: int) -> DataFrame:
    """Written: a row (media_id, digest, n_prints, fingerprint, n: its marks, row: its number) for each row of media, with key null, and (row, key,
    c: by how many rows) for the marks that several rows have. Recordings are printed once, and the marks go nowhere but to their shards; those of media
    that are equal byte by byte go once, and n is null for the others."""
    before = "shard int, block long, blob binary, media_id long, digest binary, n_prints int, fingerprint binary, n int, row long"
    after = "media_id long, digest binary, n_prints int, fingerprint binary, n int, row long, key long, c int"
    dealt, made = pa_schema(media.sparkSession, before), pa_schema(media.sparkSession, after)
    small_batches(media.sparkSession)
    kind, none = how["kind"], np.empty(0, np.uint64)

    def filled(schema, size, **got):
        return pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if f.name in got else pa.nulls(size, f.type) for f in schema], schema=schema)

    def deal(batches):
        p = Printer(how["rate"], how["frame"], how["hop"], how["low"], how["high"])
        block, held, size = TaskContext.get().partitionId() << 24, [], 0

        def blobs():
            got = packed_marks(held) if size else []
            for at in range(0, len(got), 64):
                part = got[at : at + 64]
                yield filled(dealt, len(part), shard=[k for k, _ in part], block=[block] * len(part), blob=[b for _, b in part])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                column = batch.column("media").slice(at, 64)
                got = p.prints(_media(kind, column, p))
                if held and (size >= HELD or len(held) + len(got) > BLOCK_ROWS):
                    yield from blobs()
                    block, held, size = block + 1, [], 0
                rows = [block * BLOCK_ROWS + len(held) + i for i in range(len(got))]
                copy = batch.column("copy").slice(at, 64).to_pylist()
                own = [marks(np.unique(runs(x)), sample, least) if not c else none for x, c in zip(got, copy, strict=True)]
                names = [_name(x, m) for x, m in zip(got, column, strict=True)]
                yield filled(dealt, len(got), shard=[r % (1 << SHARD_BITS) for r in rows], media_id=batch.column("media_id").slice(at, 64), digest=batch.column("digest").slice(at, 64), n_prints=[len(x) for x in got], fingerprint=names, n=[None if c else len(x) for x, c in zip(own, copy, strict=True)], row=rows)
                held += own
                size += sum(map(len, own))
        yield from blobs()
        give_back()

    def meet(table):
        info, sent = table.filter(table["blob"].is_null()), table.filter(table["blob"].is_valid())
        out = [filled(made, len(info), **{c: info[c].combine_chunks() for c in ("media_id", "digest", "n_prints", "fingerprint", "n", "row")})]
        if len(sent):
            row, key = shared_keys(sent["shard"][0].as_py(), sent["block"].to_pylist(), sent["blob"].to_pylist())
            _, at, c = np.unique(key, return_inverse=True, return_counts=True)
            c = c[at]
            out.append(filled(made, int((c > 1).sum()), row=row[c > 1], key=key[c > 1], c=c[c > 1].astype(np.int32)))
        return pa.Table.from_batches(out, schema=made)

    own = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).alias("media")).withColumn("digest", _digest("media"))
    copies = own.where("digest is not null").groupBy("digest").agg(F.min("media_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").drop("rows")
    copies = materialise(copies, "copies")
    if copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        own = own.join(F.broadcast(copies), "digest", "left").withColumn("copy", F.col("first").isNotNull() & ~F.col("media_id").eqNullSafe(F.col("first")))
    else:
        own = own.withColumn("copy", F.lit(False))
    out = materialise(plain(own.select("media_id", "media", "digest", "copy")).mapInArrow(deal, before).groupBy("shard").applyInArrow(meet, after), "marked")
    drop(copies)
    return out


# ---- over a table


def _media(kind: str, column: pa.Array, p: Printer) -> Pcm | Tones:
    if kind == "tones":
        return Tones(*text_bytes(column), p.rate, p.hop // TONE, p.least)
    return Pcm([b or b"" for b in column.to_pylist()], 8 if kind == "pcm8" else 16, p.least)


def _printed(media: DataFrame, how: dict, id_col: str, media_col: str, schema: str, emit: Callable) -> DataFrame:
    """emit(batch, blobs, prints) of each slice; prints as the options say."""
    kind = how["kind"]

    def make():
        p = Printer(how["rate"], how["frame"], how["hop"], how["low"], how["high"])

        def work(batch):
            column = batch.column("media")
            return emit(batch, column, p.prints(_media(kind, column, p)))

        return work

    return map_batches(media.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).alias("media")), schema, make, rows=64)


def _name(p: np.ndarray, media) -> bytes | None:
    """128 bits of the SHA-256 of the integers, and of the media if they are under RUN; None without integers. What tones sound like says all
    about their words, so the words stand for a text."""
    if not len(p):
        return None
    h = hashlib.sha256(p.astype("<u4").tobytes())
    if len(p) < RUN:
        m = media.as_py()
        h.update(b" ".join(m.encode().translate(LOWER.tobytes()).split()) if isinstance(m, str) else m)
    return h.digest()[:16]


def options(kind: str = "pcm8", rate: int = 8000, frame: int = 1024, hop: int = 256, low: float = 220.0, high: float = 3600.0, shared: int = 10) -> dict:
    """kind: pcm8 and pcm16 (binary), or tones (text; hop a multiple of TONE, and tones from rate / 4 to rate / 2). shared: per cent of marks that
    linked classes share; noise flips bits of most integers, but words that are the same sound the same."""
    if kind not in ("pcm8", "pcm16", "tones") or (kind == "tones" and hop % TONE):
        raise ValueError(f"kind {kind}, hop {hop}")
    return {"kind": kind, "rate": rate, "frame": frame, "hop": hop, "low": low, "high": high, "shared": shared}


#: Texts: frames of two words, a step each word; 16 Hz a bin, where semitones are 30 Hz apart at least.
TEXT = options("tones", 2048, 2 * TONE, TONE, 500.0, 1024.0, 60)


def fingerprints(media: DataFrame, *, id_col: str = "media_id", media_col: str = "pcm", how: dict | None = None) -> DataFrame:
    """media_id, n_prints, prints (binary, little-endian uint32)."""
    emit = lambda batch, _, got: {"media_id": batch.column("media_id"), "n_prints": [len(p) for p in got], "prints": [p.astype("<u4").tobytes() for p in got]}
    return _printed(media, how or options(), id_col, media_col, "media_id long, n_prints int, prints binary", emit)


def _digest(column: str) -> Column:
    """128 bits of the media as they are."""
    return F.unhex(F.md5(F.col(column).cast("binary")))


def _carried_of(media: DataFrame, nodes: DataFrame, how: dict, id_col: str, media_col: str) -> DataFrame:
    """carried, and the columns of the nodes but digest and class_id, from the recordings that stand for them: as often as those are repeated. What
    is carried to another recording is the chords of a text, and the integers of others."""
    ids = few(nodes.select(F.col("class_id").alias("id")).distinct())
    chosen = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(media_col).alias("media"))
    chosen = chosen.join(ids, chosen["media_id"].eqNullSafe(ids["id"]), "left_semi").withColumn("digest", _digest("media"))

    def make():
        p = Printer(how["rate"], how["frame"], how["hop"], how["low"], how["high"])

        def work(batch):
            own = _media(how["kind"], batch.column("media"), p)
            carried = own.slots() if isinstance(own, Tones) else [x.astype("<u4").tobytes() for x in p.prints(own)]
            return {"media_id": batch.column("media_id"), "digest": batch.column("digest"), "carried": carried}

        return work

    read = map_batches(chosen, "media_id long, digest binary, carried binary", make, rows=64)
    own = few(nodes.withColumnsRenamed({"class_id": "id", "digest": "of"}))
    return read.join(own, (read["digest"] == own["of"]) & read["media_id"].eqNullSafe(own["id"])).drop("media_id", "digest", "id", "of")


def _heard(how: dict, p: Printer, carried: list[bytes]) -> list[np.ndarray]:
    """The integers of what was carried."""
    return p.prints(Tones.of(carried, p.rate)) if how["kind"] == "tones" else [np.frombuffer(x, "<u4") for x in carried]


def _aligned(pairs: DataFrame, live: DataFrame, carried: Callable, how: dict, max_ber: float, sample: int, least: int) -> DataFrame:
    """The alignments of the pairs (x, y): x, y, shared, offset, overlap, bit_errors, linked. A written table; deletes the one of the pairs.

    Only what the ys carry is written; that of the xs goes straight to them. A worker keeps the integers of the ys of its last slice: pairs come in their order."""
    of = live.withColumnRenamed("nid", "y").join(few(pairs.select("y").distinct()), "y", "left_semi")
    centres = materialise(carried(of).groupBy("y").agg(F.max("carried").alias("cy")), "centres")
    sweep(pairs.sparkSession, now=True)
    own = materialise(live.withColumnRenamed("nid", "x").join(few(pairs), "x"), "own")
    both = carried(own).withColumnRenamed("carried", "cx").join(centres, "y").select("x", "y", "cx", "cy").sortWithinPartitions("y")
    columns = ("shared", "offset", "overlap", "bit_errors", "linked")

    def make():
        p, known = Printer(how["rate"], how["frame"], how["hop"], how["low"], how["high"]), {}

        def work(batch):
            nonlocal known
            ys, cy = batch.column("y").to_pylist(), batch.column("cy")
            places = {y: i for i, y in enumerate(ys)}
            new = [y for y in places if y not in known]
            got = _heard(how, p, [cy[places[y]].as_py() for y in new]) if new else []
            known = {y: known[y] for y in places if y in known} | {y: (g, first_runs(g)) for y, g in zip(new, got, strict=True)}
            xs = _heard(how, p, batch.column("cx").to_pylist())
            found = [align(x, known[y][0], max_ber, how["shared"], sample, least, known[y][1]) for x, y in zip(xs, ys, strict=True)]
            there = pa.array([f is not None for f in found], pa.bool_())
            return {c: batch.column(c).filter(there) for c in ("x", "y")} | {c: [f[c] for f in found if f] for c in columns}

        return work

    out = materialise(map_batches(both, "x long, y long, shared int, offset int, overlap int, bit_errors int, linked boolean", make, rows=64).distinct(), "alignments")
    drop(pairs, centres, own)
    sweep(out.sparkSession, now=True)
    return out


def _stars(held: DataFrame) -> DataFrame:
    """(x, y), one pair a node: to the most central other node (by how many have its marks) that is the most central one of a mark. A written table."""
    weights = materialise(held.groupBy("node").agg(F.sum("c").alias("weight")), "weights")
    hubs = materialise(held.join(few(weights), "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub")), "hubs")
    sweep(held.sparkSession, now=True)
    met = held.select("key", "node").join(hubs, "key").where("node != hub.node").groupBy("node").agg(F.max("hub").alias("hub"))
    out = materialise(met.select(F.col("node").alias("x"), F.col("hub.node").alias("y")), "stars")
    drop(weights, hubs)
    sweep(out.sparkSession, now=True)
    return out


def _rare(held: DataFrame, shared: int) -> DataFrame:
    """(node, n, key, i): the rarest marks of each node, as many as it can do without and still be linked. A written table."""
    placed = held.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "key"))).alias("known"))
    first = placed.withColumn("alone", F.col("n") - F.size("known"))
    first = first.withColumn("known", F.slice("known", 1, F.greatest((F.col("n") - F.ceil(F.col("n") * shared / 100) + 1).cast("int") - F.col("alone"), F.lit(0))))
    rows = first.select("node", F.col("n").cast("long").alias("n"), "alone", F.posexplode("known").alias("at", "k"))
    return materialise(rows.select("node", "n", "k.key", (F.col("at") + 1 + F.col("alone")).cast("long").alias("i")), "rare")


def recordings(media: DataFrame, *, id_col: str = "media_id", media_col: str = "pcm", how: dict | None = None, max_ber: float = MAX_BER, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """One row per row of media: media_id, n_prints, fingerprint (hex), class_id, component_id (the smallest id of the linked classes), match_id (the class it
    was aligned with), offset (steps by which it starts later in that one), shared (votes), overlap, bit_errors, aligned (linked to match_id).

    sample over 1 takes some of the runs for marks: cheaper, and wrong about links near the threshold."""
    how = how or options()
    shared = how["shared"]

    spark = media.sparkSession
    mixed = _marked(media, how, id_col, media_col, sample, least)
    sweep(spark, now=True)  # gives back what was dealt, here and below
    rows = materialise(mixed.where("key is null").drop("key", "c"), "rows")
    first = F.min(F.struct(F.col("media_id").isNull().alias("none"), "media_id", "digest")).alias("first")
    one = rows.where("fingerprint is not null").groupBy("fingerprint").agg(first, F.min(F.when(F.col("n").isNotNull(), F.col("row"))).alias("row"), F.max("n").alias("n"))
    one = one.select("fingerprint", "first.media_id", "first.digest", "row", "n").withColumnRenamed("media_id", "class_id")
    # numbers in the order of fingerprints, so that ties don't depend on the run
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    classes = materialise(one.repartitionByRange(parts, "fingerprint").sortWithinPartitions("fingerprint").withColumn("nid", F.monotonically_increasing_id()), "classes")
    # c counts rows, those of one class too: for the order of the marks by it, and for which might be shared, more will do
    held = mixed.where("key is not null").select("row", "key", "c").join(few(classes.select("row", F.col("nid").alias("node"), "n")), "row")
    held = materialise(held.select("node", "n", "key", "c"), "held")
    drop(mixed)
    sweep(spark, now=True)
    live = materialise(classes.join(few(held.select(F.col("node").alias("nid")).distinct()), "nid", "left_semi").select("nid", "digest", "class_id"), "live")
    labels = materialise(live.select(F.col("nid").alias("node"), F.col("nid").alias("label")), "labels")
    carried = lambda nodes: _carried_of(media, nodes, how, id_col, media_col)
    found = _aligned(_stars(held), live, carried, how, max_ber, sample, least)
    labels = contract(labels, found.where("linked").select("x", "y"))
    rare = _rare(held, shared)
    drop(held)
    sweep(spark, now=True)
    needed = lambda a, b: F.ceil(F.greatest(a, b) * shared / 100)
    pairs = rest(rare, labels, shared, needed)
    drop(rare)
    sweep(spark, now=True)
    more = _aligned(pairs, live, carried, how, max_ber, sample, least)
    labels = contract(labels, more.where("linked").select("x", "y"))

    # the best alignment of each class, from either side
    back = lambda t: t.select(F.col("y").alias("x"), F.col("x").alias("y"), "shared", (-F.col("offset")).alias("offset"), "overlap", "bit_errors", "linked")
    linked = found.where("linked").unionByName(more.where("linked"))
    every = found.unionByName(back(linked)).unionByName(more.where("linked")).join(live.select(F.col("nid").alias("y"), F.col("class_id").alias("match_id")), "y")
    order = F.struct("linked", "shared", F.col("match_id").isNotNull().alias("some"), (-F.col("match_id")).alias("m"), (-F.col("y")).alias("n"))
    best = every.groupBy("x").agg(F.max_by(F.struct("match_id", *FOUND, "linked"), order).alias("best"))
    named = materialise(classes.select("nid", "fingerprint", "class_id").join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid")), "named")
    smallest = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    known = named.join(smallest, "label").join(best.withColumnRenamed("x", "nid"), "nid", "left")
    known = materialise(known.select("fingerprint", "class_id", "component_id", "best.match_id", *[f"best.{c}" for c in FOUND], F.coalesce("best.linked", F.lit(False)).alias("aligned")), "known")
    drop(found, more, labels, live, classes, named)
    filled = rows.where("fingerprint is not null").select("media_id", "n_prints", "fingerprint").join(known, "fingerprint")
    out = ("media_id", "n_prints", "fingerprint", "class_id", "component_id", "match_id", *FOUND, "aligned")
    empty = rows.where("fingerprint is null").select("media_id", "n_prints", "fingerprint").withColumns({"class_id": F.col("media_id"), "component_id": F.col("media_id"), "match_id": F.lit(None).cast("long"), **{c: F.lit(None).cast("int") for c in FOUND}, "aligned": F.lit(False)})
    return filled.select(*out).unionByName(empty.select(*out)).withColumn("fingerprint", F.lower(F.hex("fingerprint")))


FOUND = ("offset", "shared", "overlap", "bit_errors")
