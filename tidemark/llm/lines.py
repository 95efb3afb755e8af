"""Line deduplication with two Bloom filters: lines seen once, and lines seen twice.

1. Every document gives the 64-bit hashes of its distinct long lines, packed by hash shard (8 bytes a line travel, no text).
2. Each shard streams its hashes through a once-filter; a hash already there goes to the twice-filter. Only twice-filters remain,
   halved by folding while they stay sparse.
3. Lines that the twice-filters suspect are shuffled as SHA-256 digests for exact counts and the largest document holding each.
4. Documents meet their own confirmed digests and lose those lines.

False positives of the filters cost a shuffled digest, never a line. Twice-filters beyond ``max_filter_bytes`` in all are not
broadcast: the hashes then travel with their doc_ids to the filters' shards, and those suspected go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, Workspace, byte_slices, mix64, partitions, span_hashes, texts, utf8_parts

PROBES = 4
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Lines:
    """The lines of a string column: document index, byte range, and the byte range and length of the key."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8_parts(column)
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        doc_of_break = np.searchsorted(offsets, breaks, "right") - 1
        self.start = np.sort(np.append(offsets[:-1], breaks + 1), kind="stable")
        self.end = np.sort(np.append(offsets[1:], breaks), kind="stable")
        self.doc = np.repeat(np.arange(n), np.bincount(doc_of_break, minlength=n) + 1) if n else np.zeros(0, np.int64)
        solid = np.flatnonzero(~_SPACE[data])
        first, last = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = last > first
        self.key_start = np.where(some, solid[np.minimum(first, max(len(solid) - 1, 0))] if len(solid) else 0, self.start)
        self.key_end = np.where(some, solid[np.maximum(last - 1, 0)] + 1 if len(solid) else 0, self.start)
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        self.points = points[self.key_end] - points[self.key_start]
        self.raw, self.data = data, _LOWER[data]

    def long(self, min_chars: int) -> np.ndarray:
        return np.flatnonzero(self.points >= min_chars)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return span_hashes(self.data, self.key_start[at], self.key_end[at])

    def digests(self, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(self.key_start[at].tolist(), self.key_end[at].tolist(), strict=True)]


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The probes of each hash in a filter of 2**bits bits; a filter folded in half drops the top bit of each."""
    a, b = mix64(h), mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    for k in range(PROBES):
        yield (a + np.uint64(k) * b) & np.uint64((1 << bits) - 1)


def _has(words: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(h), bool)
    for p in _positions(h, bits):
        found &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return found


def _add(words: np.ndarray, h: np.ndarray, bits: int) -> None:
    for p in _positions(h, bits):
        np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))


def fold(words: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Halves a filter while at most a quarter of the halved bits are set."""
    while bits > 6:
        half = words[: len(words) // 2] | words[len(words) // 2 :]
        if np.bitwise_count(half).sum() > len(half) * 16:
            break
        words, bits = half, bits - 1
    return words, bits


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _pack(shards: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            held.clear()
            shard = shard_of(h, shards)
            order = np.argsort(shard, kind="stable")
            h, shard = h[order], shard[order]
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(h) else np.zeros(0, np.int64)
            to = np.append(cut[1:], len(h))
            return pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array(to - cut, pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(cut, to, strict=True)], pa.binary())], ["shard", "n", "hashes"])

        for batch in batches:
            for lo, hi in byte_slices(batch, "text", SLICE):
                lines = Lines(batch.column("text").slice(lo, hi - lo))
                at = lines.long(min_chars)
                pair = np.unique(np.rec.fromarrays([lines.hashes(at), lines.doc[at]]))
                held.append(np.asarray(pair["f0"], np.uint64))
                if sum(map(len, held)) > 1 << 19:
                    yield flush()
        if held:
            yield flush()

    return run


def _twice(bits_a_line: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, once, twice, bits = None, None, None, 0

        def result() -> pa.RecordBatch:
            words, b = fold(twice, bits)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([b], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["shard", "bits", "words"])

        for batch in batches:
            for i in range(batch.num_rows):
                k = batch.column("shard")[i].as_py()
                if k != shard:
                    if shard is not None and twice.any():
                        yield result()
                    shard, bits = k, max(10, int(batch.column("total")[i].as_py() * bits_a_line - 1).bit_length())
                    once, twice = np.zeros(1 << (bits - 6), np.uint64), np.zeros(1 << (bits - 6), np.uint64)
                h, n = np.unique(np.frombuffer(batch.column("hashes")[i].as_py(), np.uint64), return_counts=True)
                again = (n > 1) | _has(once, h, bits)
                _add(twice, h[again], bits)
                _add(once, h[~again | (n > 1)], bits)
        if shard is not None and twice.any():
            yield result()

    return run


def _pack_with_ids(shards: int, min_chars: int):
    """The hashes of each slice of documents with their doc_ids, a row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch, "text", SLICE):
                lines = Lines(batch.column("text").slice(lo, hi - lo))
                at = lines.long(min_chars)
                h = lines.hashes(at)
                shard = shard_of(h, shards)
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(lines.doc[at][order]))
                edges = pa.array(np.append(cut, len(shard)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.ListArray.from_arrays(edges, ids), pa.ListArray.from_arrays(edges, pa.array(h[order].view(np.int64)))], ["shard", "ids", "hashes"])

    return run


def _test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shard, kind): the hashes that their shard's filter, which comes first, suspects."""
    now, words, bits = None, None, 0
    for batch in batches:
        for i in range(batch.num_rows):
            shard = batch.column("shard")[i].as_py()
            if batch.column("kind")[i].as_py() == 0:
                now, bits, words = shard, batch.column("bits")[i].as_py(), np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
            elif now == shard:
                h = np.asarray(batch.column("hashes")[i].values)
                at = np.flatnonzero(_has(words, h.view(np.uint64), bits))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values.take(pa.array(at)), pa.array(h[at])], ["doc_id", "h"])


def suspected_hashes(docs: DataFrame, twice: DataFrame, min_chars: int) -> DataFrame:
    """``of long, asked array<long>``: the suspected line hashes of each document, by a shuffle of 16 bytes a line."""
    shards = partitions(docs.sparkSession)
    lines = texts(docs).mapInArrow(_pack_with_ids(shards, min_chars), "shard int, ids array<long>, hashes array<long>")
    rows = lines.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("bits"), F.lit(None).cast("binary").alias("words"), "ids", "hashes")
    filters = twice.select("shard", F.lit(0).alias("kind"), "bits", "words", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("hashes"))
    met = filters.unionByName(rows).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return met.mapInArrow(_test, "doc_id long, h long").groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("h").alias("asked"))


def twice_filters(docs: DataFrame, work: Workspace, min_chars: int, bits_a_line: int = 12) -> DataFrame:
    """``shard int, bits int, words binary``: a Bloom filter a shard of the hashes of lines found in more than one document."""
    shards = partitions(docs.sparkSession)
    packed = work.table(texts(docs).select("text").mapInArrow(_pack(shards, min_chars), "shard int, n long, hashes binary"), "line-hashes", codec="none")
    totals = packed.groupBy("shard").agg(F.sum("n").alias("total"))  # a row a shard
    dealt = packed.join(F.broadcast(totals), "shard").repartition(shards, "shard").sortWithinPartitions("shard").select("shard", "total", "hashes")
    return work.table(dealt.mapInArrow(_twice(bits_a_line), "shard int, bits int, words binary"), "twice", codec="none")


def duplicate_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, max_filter_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: documents without the lines that recur.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Keys of ``min_chars`` code points or more in
    ``min_docs`` documents (distinct doc_ids) or more lose all their lines except in the largest doc_id holding them. Null or empty texts
    are one empty line; rows of one doc_id, repeated or not, are one document when keys are counted and keep a row each; null doc_ids are
    one document, the least; a very long text is one slice of work; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lines")
    shards = partitions(spark)
    twice = twice_filters(docs, work, min_chars)
    size = twice.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    asked, filters = texts(docs).withColumn("asked", F.lit(None).cast("array<long>")), None
    if size <= max_filter_bytes:
        filters = spark.sparkContext.broadcast({r["shard"]: (r["bits"], bytes(r["words"])) for r in twice.collect()})
    else:
        asked = texts(docs).join(suspected_hashes(docs, twice, min_chars), F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "text", "asked")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {k: (bits, np.frombuffer(w, np.uint64)) for k, (bits, w) in filters.value.items()} if filters is not None else None
        for batch in batches:
            for lo, hi in byte_slices(batch, "text", SLICE):
                lines = Lines(batch.column("text").slice(lo, hi - lo))
                at = lines.long(min_chars)
                h = lines.hashes(at)
                found = np.zeros(len(at), bool)
                if words is not None:
                    shard = shard_of(h, shards)
                    order = np.argsort(shard, kind="stable")
                    edges = np.searchsorted(shard[order], np.arange(shards + 1))
                    for k, (bits, w) in words.items():
                        own = order[edges[k] : edges[k + 1]]
                        found[own] = _has(w, h[own], bits)
                else:
                    edges = np.searchsorted(lines.doc[at], np.arange(hi - lo + 1))
                    for i in range(hi - lo):
                        wanted = np.asarray(batch.column("asked")[lo + i].values).view(np.uint64)
                        found[edges[i] : edges[i + 1]] = np.isin(h[edges[i] : edges[i + 1]], wanted)
                at = at[found]
                rows = {(d, x): None for d, x in zip(lines.doc[at].tolist(), lines.digests(at), strict=True)}
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array([d for d, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x for _, x in rows], pa.binary())], ["doc_id", "key"])

    found = work.table(asked.mapInArrow(suspects, "doc_id long, key binary").distinct(), "suspects")
    if filters is not None:
        filters.destroy()
    confirmed = work.table(found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs).select("key", "keep"), "confirmed")
    drops = found.join(confirmed, "key").where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    drops = drops.select(F.col("doc_id").alias("drop_id"), "key").groupBy("drop_id").agg(F.collect_list("key").alias("drops"))
    told = texts(docs).join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").select("doc_id", "text", "drops")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch, "text", SLICE):
                column, drops = batch.column("text").slice(lo, hi - lo), batch.column("drops").slice(lo, hi - lo)
                lines = Lines(column)
                n = np.bincount(lines.doc, minlength=hi - lo)
                ends = np.cumsum(n)
                gone = np.zeros(hi - lo, np.int64)
                out = column.to_pylist()
                raw = lines.raw.tobytes()
                for i in np.flatnonzero(np.asarray(drops.is_valid())):
                    own = np.arange(ends[i] - n[i], ends[i])
                    long = own[lines.points[own] >= min_chars]
                    dead = set(drops[int(i)].as_py())
                    lost = {j for j, x in zip(long.tolist(), lines.digests(long), strict=True) if x in dead}
                    gone[i] = len(lost)
                    out[i] = b"\n".join([raw[lines.start[j] : lines.end[j]] for j in own.tolist() if j not in lost]).decode()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(gone)], ["doc_id", "text", "n_lines", "n_dropped"])

    return told.mapInArrow(remove, "doc_id long, text string, n_lines long, n_dropped long")
