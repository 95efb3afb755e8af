"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH over windows, exact edit verification.

The CGK walk reads a window of words with one pointer: at step j it writes the word under the pointer and then moves on or stays, by a
random bit of (j, word). Windows a few edits apart soon walk in step again, so a small edit distance becomes a small Hamming distance.
Sampling some of the written positions gives an LSH key; ``REPEATS`` walks and samples are taken.

Windows go by item size: an item of n words is indexed by all its windows of W words, W being 8 for 16 words or more and 4 below, and the
corpus is read at windows of W words every W / 4 words, so each leaked passage holds several and one hit is enough. Hits are settled
by Myers' bit-parallel edit distance between the whole item and the words around the hit. Short items are found word for word only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, Workspace, byte_slices, mix64, span_hashes, texts, trim, utf8_parts

REPEATS, SAMPLES = 5, 7
PAD = np.uint64(0x5851F42D4C957F2D)
BITMAP_BITS = 22
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, digits and non-ASCII bytes, in lower case), and where each text's words start (n + 1)."""
    data, offsets = utf8_parts(pc.utf8_lower(column))
    apart = np.append(True, ~_WORD[data])
    apart[offsets] = True
    inner = _WORD[data]
    start = np.flatnonzero(inner & apart[:-1])
    after = np.append(~inner, True)
    after[offsets] = True
    end = np.flatnonzero(inner & after[1:]) + 1
    return span_hashes(data, start, end), np.searchsorted(start, offsets)


def window_of(n: int) -> int:
    return 8 if n >= 16 else 4


def _plan(width: int, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers of the walk's steps, and the sampled steps."""
    rng = np.random.default_rng((width, repeat, 20))
    steps = 2 * width
    sampled = np.zeros(steps, bool)
    sampled[rng.choice(steps, min(SAMPLES, steps), replace=False)] = True
    last = int(np.flatnonzero(sampled)[-1]) + 1
    return (rng.integers(0, 1 << 62, last, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), sampled[:last]


def window_keys(words: np.ndarray, start: np.ndarray, width: int, repeat: int) -> np.ndarray:
    """LSH keys of the windows of ``width`` words at ``start``; the walk reads a padding word beyond a window's end."""
    multiplier, sampled = _plan(width, repeat)
    tail = np.append(words, np.full(1, PAD))
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), 1 << 15):
        first = start[lo : lo + (1 << 15)]
        at, end = first.copy(), first + width
        key = np.full(len(first), repeat, np.uint64)
        for j, (c, take) in enumerate(zip(multiplier, sampled, strict=True)):
            w = tail[at] if j < width else np.where(at < end, tail[np.minimum(at, len(words))], PAD)
            if take:
                key = (key ^ w) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            at += ((w * c) >> np.uint64(63)).astype(np.int64)
        out[lo : lo + (1 << 15)] = mix64(key)
    return out


def run_keys(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words at ``start``."""
    key = np.zeros(len(start), np.uint64)
    for j in range(n):
        key = mix64(key ^ words[start + j]) + np.uint64(j + 1)
    return key


def edit_distance(peq: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of a pattern of n words to any run of ``text``, and where that run ends (Myers 1999, over words)."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, where = full, 0, n, n, 0
    for i, w in enumerate(text, 1):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, where = score, i
    return best, where


class Items:
    """An index of benchmark items: LSH keys of all their windows; of items under ``min_words`` words a hash of all words in order."""

    def __init__(self, ids: list[int], texts_: list[str], similarity: float, min_words: int):
        words, at = word_hashes(pa.array(texts_, pa.string()))
        self.ids, self.words, self.items, self.similarity = [], [], [], similarity
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if b > a:
                self.ids.append(ids[i])
                self.words.append(words[a:b])
                peq: dict[int, int] = {}
                for k, w in enumerate(words[a:b].tolist()):
                    peq[w] = peq.get(w, 0) | 1 << k
                self.items.append(peq)
        self.index = {}
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in self.words if len(w) < min_words}):
            item = np.array([k for k, w in enumerate(self.words) if len(w) == n])
            keys = run_keys(np.concatenate([self.words[k] for k in item]), np.arange(len(item)) * n, n)
            order = np.argsort(keys)
            self.short[n] = keys[order], item[order]
        for width in sorted({window_of(len(w)) for w in self.words if len(w) >= min_words}):
            own = [(k, o) for k, w in enumerate(self.words) if len(w) >= min_words and window_of(len(w)) == width for o in range(len(w) - width + 1)]
            item, offset = np.array([k for k, _ in own]), np.array([o for _, o in own])
            base = np.cumsum([0, *map(len, self.words)])
            start = base[item] + offset
            tables = []
            for r in range(REPEATS):
                keys = window_keys(np.concatenate(self.words), start, width, r)
                order = np.argsort(keys)
                bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
                bit = keys & np.uint64((1 << BITMAP_BITS) - 1)
                np.bitwise_or.at(bitmap, (bit >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)))
                tables.append((keys[order], item[order], offset[order], bitmap))
            self.index[width] = tables

    def verbatim(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``matches`` of the short items: the first place of each in each text."""
        found = []
        for n, (keys, item) in self.short.items():
            runs = np.maximum(0, np.diff(at) - n + 1)
            doc = np.repeat(np.arange(len(runs)), runs)
            start = at[doc] + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
            key = run_keys(words, start, n)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            seen = set()
            for i in np.flatnonzero(hi > lo).tolist():
                for k in item[lo[i] : hi[i]].tolist():
                    if (doc[i], k) not in seen and (self.words[k] == words[start[i] : start[i] + n]).all():
                        seen.add((doc[i], k))
                        first = int(start[i] - at[doc[i]])
                        found.append((int(doc[i]), k, first, first + n, 0))
        return found

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, end word, edit distance) of every item found in each text, the best place of each."""
        words, at = word_hashes(column)
        rows: list[np.ndarray] = []
        for width, tables in self.index.items():
            stride = max(1, width // 4)
            n = np.maximum(0, (np.diff(at) - width) // stride + 1)
            doc = np.repeat(np.arange(len(n)), n)
            start = at[doc] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * stride
            for r, (keys, item, offset, bitmap) in enumerate(tables):
                key = window_keys(words, start, width, r)
                bit = key & np.uint64((1 << BITMAP_BITS) - 1)
                hit = np.flatnonzero((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                many = hi - lo
                which = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                rows.append(np.stack([np.repeat(doc[hit], many), item[which], np.repeat(start[hit], many) - offset[which]]))
        found = self.verbatim(words, at)
        if not rows:
            return found
        hits = np.unique(np.concatenate(rows, axis=1), axis=1)  # (row, item, place where the item would start), sorted
        i, total = 0, hits.shape[1]
        doc_, item_, place_ = (x.tolist() for x in hits)
        while i < total:
            d, k = doc_[i], item_[i]
            n = len(self.words[k])
            allowed = int((1 - self.similarity) * n + 1e-9)
            best = None
            while i < total and doc_[i] == d and item_[i] == k:
                first = last = place_[i]
                i += 1
                while i < total and doc_[i] == d and item_[i] == k and place_[i] <= last + allowed + 1:
                    last = place_[i]
                    i += 1
                a, b = max(int(at[d]), first - allowed), min(int(at[d + 1]), last + n + allowed)
                if b - a < n - allowed:
                    continue
                distance, end = edit_distance(self.items[k], n, words[a:b].tolist())
                if distance <= allowed and (best is None or distance < best[2]):
                    best = a + end - n - int(at[d]), a + end - int(at[d]), distance
            if best is not None:
                found.append((d, k, max(0, best[0]), best[1], best[2]))
        return found


def item_blocks(benchmark: DataFrame, similarity: float, min_words: int, block_chars: int) -> Iterator[Items]:
    """Indexes of the benchmark in blocks of bounded size; null texts are empty."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // block_chars
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows], similarity, min_words)


FOUND = "doc_id long, item_id long, first_word int, end_word int, item_words int, distance int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 8, block_chars: int = 1 << 22) -> DataFrame:
    """``doc_id, item_id, first_word, end_word, item_words, distance``: every item found in every row of ``docs(doc_id, text)``.

    An item of n words is found where some run of the document's words lies within (1 - similarity) * n word edits of it. Words are runs
    of letters and digits in lower case, so punctuation, case and line breaks don't matter. Items under ``min_words`` words are found
    where all their words stand in order, without edits; items without words match nothing; null texts are empty; repeated rows and items are reported each; whole texts are read. The benchmark
    is indexed in blocks of ``block_chars`` characters, one pass over the corpus a block. Other columns are ignored.
    """
    spark = docs.sparkSession
    Workspace(spark, "leaks")
    out = None
    for items in item_blocks(benchmark, similarity, min_words, block_chars):
        shared = spark.sparkContext.broadcast(items)  # bounded by block_chars
        found = texts(docs).mapInArrow(_report(shared), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def _report(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for lo, hi in byte_slices(batch, "text", SLICE):
                got = items.matches(batch.column("text").slice(lo, hi - lo))
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array([g[0] for g in got], pa.int64()))
                rest = [[items.ids[g[1]] for g in got], [g[2] for g in got], [g[3] for g in got], [len(items.words[g[1]]) for g in got], [g[4] for g in got]]
                yield pa.RecordBatch.from_arrays([ids, pa.array(rest[0], pa.int64()), *(pa.array(x, pa.int32()) for x in rest[1:])], ["doc_id", "item_id", "first_word", "end_word", "item_words", "distance"])
        trim()

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 8, block_chars: int = 1 << 22) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found (see ``find_leaks``). Rows are judged in place: nothing is shuffled."""
    spark = docs.sparkSession
    Workspace(spark, "leaks")
    for items in item_blocks(benchmark, similarity, min_words, block_chars):
        docs = docs.mapInArrow(_filter(spark.sparkContext.broadcast(items)), docs.schema)
    return docs


def _filter(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            text = batch.column("text").cast(pa.string()).fill_null("")
            for lo, hi in byte_slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", SLICE):
                clean = np.ones(hi - lo, bool)
                clean[[g[0] for g in items.matches(text.slice(lo, hi - lo))]] = False
                yield batch.slice(lo, hi - lo).filter(pa.array(clean))
        trim()

    return run
