"""Suffix-array deduplication: bytes covered by a long string that also starts elsewhere are removed.

Comparing every suffix of a corpus with every shard is out of reach, so shards get only what can repeat, and everything that can:

1. Each window of ``length`` bytes is named by its smallest 32-byte gram by hash (its anchor, the leftmost of ties). Equal windows have
   equal anchors, so only windows of anchors seen twice can repeat. Consecutive windows with one anchor form a snippet.
2. Snippets meet by anchor hash. Those equal byte for byte (by digest) are repeated as a whole and done; within a batch of documents
   they are merged before anything is shuffled, so a passage copied a million times is at most a row a batch.
3. Unlike snippets of one anchor go, with their bytes, to shards. A shard sorts its suffixes by Larsson-Sadakane refinement in numpy and
   finds common prefixes with Kasai's bound; windows with no common prefix under ``length`` bytes between them in the array are repeated.
4. An anchor with more than ``hot_rows`` unlike snippets is dealt over several shards. Their sorted windows are then merged: digests are
   range-partitioned and each run is searched for the others' windows by binary search.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_slices, mix64, partitions, texts, utf8_parts, words_at

GRAM = 32
SEGMENT = 1 << 22
DONE, OPEN, KNOWN = 0, 1, 2
MAX_BROADCAST_DOCS = 500_000
_C = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minima of blocks forward and backward."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def snippets(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash) of all snippets: runs of windows inside one document with one anchor."""
    out = []
    for base in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        if len(part) < length:
            break
        w = words_at(part)[: len(part)]
        n = len(part) - GRAM + 1
        h = w[:n].copy()
        for k in (8, 16, 24):
            h = mix64(h * _C + w[k : k + n])
        chosen = sliding_min((h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64), length - GRAM + 1)
        anchor = (chosen & np.uint64((1 << 24) - 1)).astype(np.int64)
        here = np.arange(base, base + len(anchor))
        inside = np.zeros(len(anchor) + 1, np.int32)  # documents' last length - 1 starts have no window
        lo = np.clip(np.maximum(offsets[1:] - length + 1, offsets[:-1]) - base, 0, len(anchor))
        hi = np.clip(offsets[1:] - base, 0, len(anchor))
        np.add.at(inside, lo, 1)
        np.add.at(inside, hi, -1)
        valid = np.cumsum(inside[:-1]) == 0
        first = valid & np.append(True, (anchor[1:] != anchor[:-1]) | ~valid[:-1])
        last = valid & np.append((anchor[1:] != anchor[:-1]) | ~valid[1:], True)
        out.append((here[first], here[last], h[anchor[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


ANCHORS = "h long, g long, doc_id long, th long, lo int, hi int, repeated boolean, stands boolean"


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for a, b in byte_slices(batch, "text", 1 << 24):
                data, offsets = utf8_parts(batch.column("text").slice(a, b - a))
                lo, hi, h = snippets(data, offsets, length)
                doc = np.searchsorted(offsets, lo, "right") - 1
                raw = data.tobytes()
                g = np.array([digest(raw[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)], np.uint64)
                order = np.lexsort((lo, g, h))
                new = np.append(True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])) if len(order) else np.zeros(0, bool)
                sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
                stands, repeated = np.zeros(len(lo), bool), np.zeros(len(lo), bool)
                stands[order[new]] = True
                repeated[order[new]] = sizes > 1
                repeated[~stands] = True
                # repeated snippets that stand for none travel merged with their neighbours
                rest = np.flatnonzero(~stands)
                fresh = np.append(True, (doc[rest][1:] != doc[rest][:-1]) | (lo[rest][1:] != hi[rest][:-1] + 1)) if len(rest) else np.zeros(0, bool)
                start = np.flatnonzero(fresh)
                end = np.append(start[1:], len(rest)) - 1
                keep = np.flatnonzero(stands)
                row = np.append(keep, rest[start])
                last = np.append(hi[keep], hi[rest[end]] if len(rest) else []).astype(np.int64)
                d, at = doc[row], offsets[doc[row]]
                key = np.append(h[keep], mix64(h[rest[start]] + lo[rest[start]].astype(np.uint64)))
                ids = batch.column("doc_id").slice(a, b - a).take(pa.array(d))
                th = np.asarray(batch.column("th").slice(a, b - a))[d] if len(d) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(g[row].view(np.int64)), ids, pa.array(th), pa.array((lo[row] - at).astype(np.int32)), pa.array((last - at).astype(np.int32)), pa.array(repeated[row]), pa.array(np.arange(len(row)) < len(keep))],
                    ["h", "g", "doc_id", "th", "lo", "hi", "repeated", "stands"],
                )

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, g): repeated snippets (DONE), and those that must be compared with unlike ones of their anchor."""
    held, before = None, None
    for batch in itertools.chain(batches, [None]):
        table = pa.Table.from_batches([x for x in (held, batch) if x is not None]) if held is not None or batch is not None else None
        if table is None or not table.num_rows:
            continue
        rows = table.combine_chunks().to_batches()[0]
        h, g, stands = np.asarray(rows.column("h")), np.asarray(rows.column("g")), np.asarray(rows.column("stands"))
        new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        start = np.flatnonzero(new)
        if batch is not None:
            held, rows = rows.slice(int(start[-1])), rows.slice(0, int(start[-1]))
            following = int(h[start[-1]]) if stands[start[-1]] else None
            start = start[:-1]
        else:
            held, following = None, None
        n = rows.num_rows
        if not n:
            continue
        h, stands, repeated = h[:n], stands[:n], np.asarray(rows.column("repeated"))
        group = np.cumsum(new[:n]) - 1
        size = np.bincount(group, stands)
        again = np.bincount(group, repeated & stands) + (size > 1) > 0
        first_h, real = h[start], size > 0
        unlike = np.zeros(len(start), bool)
        same = (first_h[1:] == first_h[:-1]) & real[1:] & real[:-1]
        unlike[1:] |= same
        unlike[:-1] |= same
        unlike[0] |= before is not None and before == int(first_h[0]) and bool(real[0])
        unlike[-1] |= following is not None and following == int(first_h[-1]) and bool(real[-1])
        before = int(first_h[-1]) if real[-1] else None
        done = np.flatnonzero(~stands | again[group])
        open_ = np.flatnonzero(stands & ~again[group] & unlike[group])
        known = start[unlike & again]
        at = np.concatenate([done, open_, known])
        kind = np.repeat(np.array([DONE, OPEN, KNOWN], np.int32), [len(done), len(open_), len(known)])
        out = rows.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([pa.array(kind), *(out.column(c) for c in ("h", "doc_id", "th", "lo", "hi"))], ["kind", "h", "doc_id", "th", "lo", "hi"])


class SuffixArray:
    """Suffixes of ``data`` at ``at`` in the order of their first ``length`` bytes, by Larsson-Sadakane refinement.

    Suffixes start in groups of equal 8-byte prefixes; a round sorts the members of groups of two or more by the group of the suffix
    h bytes on, which doubles the sorted prefix; groups of one are never touched again. The last round steps less than h.
    """

    def __init__(self, data: np.ndarray, length: int):
        n = len(data)
        self.data, self.length = data, length
        key = words_at(data).byteswap()
        self.sa = np.argsort(key, kind="stable")
        sorted_key = key[self.sa]
        first = np.append(True, sorted_key[1:] != sorted_key[:-1])
        self.rank = np.empty(n, np.int64)
        self.rank[self.sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        done = 8
        while done < length:
            step = min(done, length - done)
            alone = first & np.append(first[1:], True)
            open_ = np.flatnonzero(~alone)
            if not len(open_):
                break
            own = self.sa[open_]
            ahead = own + step
            second = np.where(ahead < n, self.rank[np.minimum(ahead, n - 1)] + 1, 0)
            both = (self.rank[own] << 32) | second
            order = np.argsort(both, kind="stable")
            own, both = own[order], both[order]
            self.sa[open_] = own
            split = np.append(True, both[1:] != both[:-1])
            first[open_] = split
            self.rank[own] = open_[np.maximum.accumulate(np.where(split, np.arange(len(own)), 0))]
            done += step

    def common_prefixes(self) -> np.ndarray:
        """Bytes each suffix shares with the one before it in the array, up to ``length``; by text position.

        Kasai: a suffix shares at least one byte less than the suffix a place before it in the text. Every 32nd position is compared
        from scratch; the positions between start at the bound.
        """
        n, limit = len(self.data), self.length
        before = np.full(n, -1, np.int64)
        before[self.sa[1:]] = self.sa[:-1]
        words = words_at(np.append(self.data, np.zeros(limit + 8, np.uint8)))
        shared = np.zeros(n, np.int64)

        def extend(at: np.ndarray) -> None:
            at = at[before[at] >= 0]
            while len(at):
                a, b = at + shared[at], before[at] + shared[at]
                x = words[np.minimum(a, n + limit)] ^ words[np.minimum(b, n + limit)]
                zero = x == 0
                low = np.where(zero, np.uint64(1), x & (~x + np.uint64(1)))
                shared[at] = np.minimum(limit, shared[at] + np.where(zero, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3))
                at = at[zero & (shared[at] < limit)]

        extend(np.arange(0, n, 32))
        rest = np.flatnonzero(np.arange(n) % 32)
        shared[rest] = np.maximum(0, shared[rest // 32 * 32] - rest % 32)
        # the bound holds for whole suffixes; capped values lose at most what they give up here
        extend(rest)
        shared[before < 0] = 0
        return np.minimum(shared, n - np.arange(n))


def repeated_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset) of all windows, whether each also starts elsewhere among them, and whether it is the first of its kind."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[piece] + offset
    array = SuffixArray(data, length)
    whole = np.zeros(len(data), bool)
    whole[at] = True
    # only whole windows count: two neighbours among them are equal if no common prefix between them in the array is shorter than a window
    here = np.flatnonzero(whole[array.sa])
    order = array.sa[here]
    apart = np.cumsum(array.common_prefixes()[array.sa] < length)
    prior = apart[here[1:]] == apart[here[:-1]]
    equal = np.zeros(len(data), bool)  # to the window before it
    equal[order[1:]] = prior
    twice = equal.copy()
    twice[order[:-1]] |= prior
    return piece, offset, twice[at], ~equal[at]


SNIPPETS = "h long, salt int, doc_id long, th long, lo int, kind int, bytes binary"


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, doc, th, wants in zip(batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("wants").to_pylist(), strict=True):
                raw = text.as_py().encode()
                rows += [(w["h"], w["salt"], doc, th, w["lo"], w["kind"], raw[w["lo"] : w["hi"] + length]) for w in wants]
                if len(rows) > 20_000:
                    yield _batch(rows, SNIPPETS)
                    rows = []
            if rows:
                yield _batch(rows, SNIPPETS)

    return run


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


FOUND = "doc_id long, th long, lo int, hi int, d1 long, d2 long, repeated boolean"


def _shard(length: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def solve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            piece, offset, twice, first = repeated_windows([r["bytes"] for r in rows], length)
            open_ = np.array([r["kind"] == OPEN for r in rows])
            spread = np.array([r["salt"] >= 0 for r in rows])
            known = ~open_
            out = []
            # maximal runs of repeated windows of snippets not settled yet
            hit = np.flatnonzero(twice & open_[piece])
            if len(hit):
                new = np.append(True, (np.diff(hit) > 1) | (piece[hit][1:] != piece[hit][:-1]))
                start = hit[new]
                end = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
                out += [(rows[p]["doc_id"], rows[p]["th"], rows[p]["lo"] + a, rows[p]["lo"] + b, None, None, True) for p, a, b in zip(piece[start].tolist(), offset[start].tolist(), offset[end].tolist(), strict=True)]
            # windows of spread anchors: one of each kind meets those of other shards, by digest
            for i in np.flatnonzero(spread[piece] & first).tolist():
                r, o = rows[piece[i]], int(offset[i])
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(r["bytes"][o : o + length]), "<i8").tolist()
                out.append((r["doc_id"], r["th"], r["lo"] + o, r["lo"] + o, d1, d2, bool(twice[i] or known[piece[i]])))
                if len(out) > 50_000:
                    yield _batch(out, FOUND)
                    out = []
            yield _batch(out, FOUND)

        last = None
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["h"], r["salt"])
                if key != last and size > shard_bytes:
                    yield from solve(held)
                    held, size = [], 0
                last = key
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield from solve(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of spread anchors, sorted by digest: those whose digest another shard holds are repeated."""
    held = None
    for batch in itertools.chain(batches, [None]):
        parts = [x for x in (held, batch) if x is not None]
        if not parts:
            continue
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()
        if not rows:
            continue
        rows = rows[0]
        d = np.rec.fromarrays([np.asarray(rows.column("d1")), np.asarray(rows.column("d2"))])
        cut = rows.num_rows if batch is None else int(np.searchsorted(d, d[-1], "left"))
        held = rows.slice(cut) if batch is not None else None
        d, rows = d[:cut], rows.slice(0, cut)
        n = np.searchsorted(d, d, "right") - np.searchsorted(d, d, "left")
        at = np.flatnonzero(n > 1)
        out = rows.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([out.column(c) for c in ("doc_id", "th", "lo", "hi")], ["doc_id", "th", "lo", "hi"])


SPANS = "doc_id long, th long, lo int, hi int"


def repeated_spans(docs: DataFrame, work: Workspace, length: int, hot_rows: int, shard_bytes: int) -> DataFrame:
    """``doc_id, th, lo, hi``: runs of window starts in ``docs(doc_id, text, th)`` whose windows start elsewhere too."""
    spark = docs.sparkSession
    n = partitions(spark)
    anchors = docs.mapInArrow(_anchor_rows(length), ANCHORS)
    settled = work.table(anchors.repartition(n, "h").sortWithinPartitions("h", "g").mapInArrow(_settle, "kind int, h long, doc_id long, th long, lo int, hi int"), "settled")
    done = settled.where(F.col("kind") == DONE).select("doc_id", "th", "lo", "hi")
    unsettled = settled.where(F.col("kind") != DONE)
    hot = work.table(unsettled.groupBy("h").count().where(F.col("count") > hot_rows), "hot-anchors")
    if hot.isEmpty():
        unsettled = unsettled.withColumn("salt", F.lit(-1))
    else:
        shards = F.ceil(F.col("count") / hot_rows).cast("long")
        unsettled = unsettled.join(hot, "h", "left").withColumn("salt", F.when(F.col("count").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id", "th", "lo"), shards)).cast("int"))
    wants = unsettled.groupBy(F.col("doc_id").alias("w_doc"), F.col("th").alias("w_th")).agg(F.collect_list(F.struct("h", "salt", "lo", "hi", "kind")).alias("wants"))
    wants = work.table(wants, "unsettled")
    small = wants.count() <= MAX_BROADCAST_DOCS
    keys = wants.select("w_doc", "w_th")
    alike = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("th") == F.col("w_th"))
    if small:  # a bounded list of documents: the texts of all others need not move
        docs = docs.join(F.broadcast(keys), alike, "left_semi")
    pieces = docs.join(wants, alike).select("text", "doc_id", "th", "wants").mapInArrow(_fetch(length), SNIPPETS)
    found = work.table(pieces.repartition(n, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_shard(length, shard_bytes), FOUND), "windows")
    spans = done.unionByName(found.where("repeated and d1 is null").select("doc_id", "th", "lo", "hi"))
    if not hot.isEmpty():
        spread = found.where("d1 is not null").repartitionByRange(n, "d1", "d2").sortWithinPartitions("d1", "d2")
        cross = spread.select("doc_id", "th", "lo", "hi", "d1", "d2").mapInArrow(_merge, SPANS)
        spans = spans.unionByName(cross)
    return spans


def remove_repeats(docs: DataFrame, length: int = 200, hot_rows: int = 5000, shard_bytes: int = 1 << 21) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary``: documents without bytes of strings of ``length`` bytes that recur.

    Texts are UTF-8 bytes (null: empty). A byte goes if a string of ``length`` bytes covering it starts anywhere else in the table, the same
    document included; strings are judged on the input and never cross documents. Repeated rows repeat each other. Null doc_ids keep
    their row; shorter texts lose nothing; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "suffixes")
    docs = texts(docs).withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(docs, work, length, hot_rows, shard_bytes)
    spans = spans.groupBy(F.col("doc_id").alias("s_doc"), F.col("th").alias("s_th")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    told = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("th") == F.col("s_th")), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_py().encode()
                runs: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"] + length) for s in spans or ()):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                edges = [0, *itertools.chain(*runs), len(raw)]
                rows.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
            yield _batch(rows, KEPT)

    return told.mapInArrow(cut, KEPT)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
