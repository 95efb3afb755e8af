"""Quality by an interpolated modified Kneser-Ney model over UTF-8 bytes, trained on trusted text.

* Trusted are the documents labelled quality 1 and toxic 0; all their n-grams are counted, by language, in two folds by doc_id. A document
  is scored by the model of the fold it does not belong to, so trusted documents are held out from their own scores and the
  thresholds fit unseen text.
* Counts of the highest order are sums; a lower order counts the distinct n-grams that continue to the left. Discounts come from counts
  of counts of each order and model.
* A document of a language without a model in the other fold is scored by that fold's model of all languages.
* A document has two perplexities: that of all its bytes, and that of its least likely passage of ``PASSAGE`` bytes (about a word), which
  a few foreign words in usual prose raise. It is rejected if one of them is above the quantile of trusted documents of its language
  and length band (powers of two of bytes); a group of few trusted documents takes the quantile of its language, then of the band in all
  languages, then of all.

Counts and questions meet in joins sharded by (model, context). The shard of an n-gram is a hash of its model and of the two bytes before
its last one, so all orders from 3 up of an n-gram and their contexts lie in one shard; orders 1 and 2 (65,536 n-grams a model at most)
are fitted a model a task and go to each shard. Documents form blocks of bounded size. A block asks each shard once for each
distinct n-gram of its texts; its rows, packed, and the answers meet by the block's hash. The questions to one shard of a model grow with the corpus, so they
are dealt out by block into slices of about ``SLICE_GRAMS`` n-grams, each of which meets a copy of the shard, and tasks grow in number with all questions.
Nothing but thresholds, model names and a sum reaches the driver, and nothing is broadcast but the ids of trusted documents, up to ``MAX_BROADCAST_IDS``, and
tables that Spark finds small.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_slices, mix64, packed_rows, partitions, row_blocks, trim, utf8_parts

ORDER = 5
PASSAGE = 6
MAX_BROADCAST_IDS = 2_000_000
LENGTH_BANDS = 32
GRAIN = 1000  # thresholds are in thousandths of a bit
SLICE = 1 << 18  # bytes of text worked on at once: about 90 bytes of arrays each
BLOCK = 16 << 20  # bytes of text of a block; a longer text is a block of its own
SHARD_GRAMS = 100_000
SLICE_GRAMS = 1 << 22  # n-grams that blocks ask one copy of a shard for
TASK_GRAMS = 1 << 23  # n-grams asked, over all blocks, a task: about 250 MB of packed rows, questions and answers


def ngram_keys(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes from ``lo`` to ``hi`` of joined texts: the n-gram of ``ORDER`` bytes that ends there (zeros before a text), its text, its place there."""
    first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
    row = np.repeat(np.arange(first, last), np.diff(np.clip(offsets[first : last + 1], lo, hi)))
    into = np.arange(lo, hi) - offsets[row]
    key = np.zeros(hi - lo, np.uint64)
    for back in range(ORDER - 1, -1, -1):
        own = data[max(lo - back, 0) : max(hi - back, 0)]
        own = np.concatenate([np.zeros(hi - lo - len(own), np.uint8), own]) if len(own) < hi - lo else own
        key = (key << np.uint64(8)) | np.where(into >= back, own, 0).astype(np.uint64)
    return key, row, into


def slices(size: int) -> Iterator[tuple[int, int]]:
    return ((lo, min(lo + SLICE, size)) for lo in range(0, size, SLICE))


def lower(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of each n-gram."""
    return grams & np.uint64((1 << (8 * order)) - 1)


def shard_of(grams: np.ndarray, model: str, shards: int) -> np.ndarray:
    return (((grams >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(2654435761) + np.uint64(zlib.crc32(model.encode()))) % np.uint64(shards)


def shard_column(shards: int) -> Column:
    """``shard_of`` of the columns g and m."""
    return F.pmod(F.shiftrightunsigned("g", 8).bitwiseAND(0xFFFF) * F.lit(2654435761) + F.crc32(F.col("m").cast("binary")), F.lit(shards)).cast("int")


def model_of(ids: pa.Array, langs: pa.Array, own: bool) -> list[str]:
    """'fold|language' of each row: the model that it trains (own fold) or that scores it (the other fold). Null languages are ''."""
    number = np.asarray(ids.cast(pa.int64()).fill_null(0)).view(np.uint64)
    fold = (mix64(number) & np.uint64(1)).astype(np.int64)
    return [f"{f}|{x or ''}" for f, x in zip((fold if own else 1 - fold).tolist(), langs.to_pylist(), strict=True)]


def settled(models: list[str], known: frozenset[str]) -> list[str]:
    """The models that score: 'fold', the model of all languages, where 'fold|language' was not trained."""
    return [m if m in known else m.split("|", 1)[0] for m in models]


def length_bands(n_bytes: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n_bytes.astype(np.float64))[1], LENGTH_BANDS - 1)


def length_band(n_bytes: str) -> Column:
    """``length_bands`` of a long column: the length of its binary digits."""
    return F.when(F.col(n_bytes) > 0, F.least(F.length(F.bin(n_bytes)), F.lit(LENGTH_BANDS - 1))).otherwise(0)


def runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows alike in ``by``, across batches."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([np.asarray(batch.column(c).dictionary_encode("encode").indices) for c in by])
        cuts = np.flatnonzero(np.append(True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
            here = tuple(batch.column(c)[a].as_py() for c in by)
            if held and here != now:
                yield now, held
                held = []
            now = here
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def pack(grams: np.ndarray) -> bytes:
    """Ascending n-grams, as compressed differences."""
    return pa.compress(np.ascontiguousarray(np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(packed, n * 8, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


# --- counts ----------------------------------------------------------------------------------------------------------------------------------


class Distinct:
    """Distinct n-grams by model of slices of text, and if wanted their counts."""

    MERGE = 1_500_000

    def __init__(self, counts: bool = True):
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray | None]]] = {}
        self.counts, self.size = counts, 0

    def add(self, column: pa.Array, models: list[str]) -> None:
        data, offsets = utf8_parts(column)
        names, which = np.unique(np.array(models, dtype=object), return_inverse=True) if models else ((), np.zeros(0, np.int64))
        for lo, hi in slices(len(data)):
            key, row, _ = ngram_keys(data, offsets, lo, hi)
            of = which[row]
            for i in np.unique(of).tolist():
                own = key[of == i] if len(names) > 1 else key
                self.held.setdefault(names[i], []).append(np.unique(own, return_counts=True) if self.counts else (np.unique(own), None))
                self.size += len(self.held[names[i]][-1][0])
            if self.size > self.MERGE:
                self._merge()

    def _merge(self) -> None:
        for m, parts in self.held.items():
            if len(parts) > 1 and self.counts:
                g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                self.held[m] = [(g, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64))]
            elif len(parts) > 1:
                self.held[m] = [(np.unique(np.concatenate([p[0] for p in parts])), None)]
        self.size = sum(len(parts[0][0]) for parts in self.held.values())

    def pop(self) -> Iterator[tuple[str, np.ndarray, np.ndarray | None]]:
        self._merge()
        for m, ((g, c),) in self.held.items():
            yield m, g, c
        self.held, self.size = {}, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Distinct()

    def flush() -> Iterator[pa.RecordBatch]:
        for m, g, c in grams.pop():
            yield pa.RecordBatch.from_arrays([pa.array([m]).take(pa.array(np.zeros(len(g), np.int32))), pa.array(g.view(np.int64)), pa.array(c)], ["m", "g", "c"])

    for batch in batches:
        models = model_of(batch.column("doc_id"), batch.column("lang"), own=True)
        for lo, hi in byte_slices(batch, "text", BLOCK):
            grams.add(batch.column("text").slice(lo, hi - lo), models[lo:hi])
            if grams.size > Distinct.MERGE:
                yield from flush()
    yield from flush()
    trim()


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of documents labelled quality 1 and toxic 0 (of several labels, the worst counts)."""
    worst = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return worst.where("q = 1 and t = 0 and doc_id is not null").select("doc_id")


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


COUNTS = "s int, m string, n long, grams binary, counts binary, of_counts array<long>, pairs array<int>, before array<long>"


def _shard_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a shard of a model: its n-grams and counts packed, how many n-grams of orders 5, 4 and 3 have count 1 to 4, and for pairs of bytes (order 2) the number of distinct bytes before them."""
    for (s, m), parts in runs(batches, ("s", "m")):
        g, c = (np.concatenate([np.asarray(p.column(x)) for p in parts]) for x in ("g", "c"))
        own, count, of = g.view(np.uint64), c, []
        for order in range(ORDER, 2, -1):
            of += [int((count == i).sum()) for i in (1, 2, 3, 4)]
            own, count = np.unique(lower(own, order - 1), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([s], pa.int32()), pa.array([m]), pa.array([len(g)], pa.int64()), pa.array([pack(g.view(np.uint64))], pa.binary()), pa.array([pa.compress(c.astype(np.int64).tobytes(), codec="zstd", asbytes=True)], pa.binary()), pa.array([of], pa.list_(pa.int64())),
             pa.array([own.astype(np.int32)], pa.list_(pa.int32())), pa.array([count.astype(np.int64)], pa.list_(pa.int64()))],
            ["s", "m", "n", "grams", "counts", "of_counts", "pairs", "before"],
        )


# --- the model -------------------------------------------------------------------------------------------------------------------------------


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more (Chen and Goodman 1998); 0.5, 1 and 1.5 where a count of counts is zero."""
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(max(0.1, min(float(i), i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def _order(grams: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one order's n-grams: their discounted shares, their contexts, and the weight each context leaves to lower orders."""
    off = d[np.minimum(counts, 3)]
    contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
    total = np.bincount(at, counts)
    return (counts - off) / total[at], contexts, np.bincount(at, off) / total


def _look(table: np.ndarray, value: np.ndarray, keys: np.ndarray, missing: float | np.ndarray) -> np.ndarray:
    if not len(table):
        return np.broadcast_to(missing, keys.shape)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, value[at], missing)


FITTED = "m string, discounts binary, pairs binary, shares binary, left binary, single binary"


def _fit_low(pairs: pa.Table, of_counts: pa.Table) -> pa.Table:
    """One model's orders 1 and 2, from at most 65,536 pairs, and its discounts of orders 5, 4 and 3."""
    order = np.argsort(np.asarray(pairs.column("pair")))
    two, c2 = np.asarray(pairs.column("pair"))[order].astype(np.uint64), np.asarray(pairs.column("before"))[order]
    one, c1 = np.unique(lower(two, 1), return_counts=True)
    d1, d2 = (discounts(*(float((c == i).sum()) for i in (1, 2, 3, 4))) for c in (c1, c2))
    share, _, left = _order(one, c1, d1)
    single = np.full(256, left[0] / 256)
    single[one.astype(np.int64)] += share
    share, contexts, weight = _order(two, c2, d2)
    left = np.ones(256)
    left[contexts.astype(np.int64)] = weight
    high = np.concatenate([discounts(*(float(of_counts.column(f"n{order}{i}")[0].as_py()) for i in (1, 2, 3, 4))) for order in range(ORDER, 2, -1)])
    return pa.table([[of_counts.column("m")[0].as_py()], *([x.tobytes()] for x in (high, two, share, left, single))], schema=pa.schema([("m", pa.string()), *((x, pa.binary()) for x in ("discounts", "pairs", "shares", "left", "single"))]))


class Shard:
    """What one shard of one model knows: the probabilities of its n-grams of all orders."""

    def __init__(self, low: dict, counted: dict | None):
        f8 = lambda x: np.frombuffer(low[x], np.float64)
        self.pairs, self.shares, self.left, self.single = np.frombuffer(low["pairs"], np.uint64), f8("shares"), f8("left"), f8("single")
        self.tables = []
        if counted is not None:
            g = unpack(counted["grams"], counted["n"])
            c = np.frombuffer(pa.decompress(counted["counts"], counted["n"] * 8, codec="zstd", asbytes=True), np.int64)
            for order, d in zip(range(ORDER, 2, -1), f8("discounts").reshape(-1, 4), strict=True):
                self.tables.append((order, g, *_order(g, c, d)))
                g, c = np.unique(lower(g, order - 1), return_counts=True)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last byte of each n-gram after the others."""
        p = self.left[((grams >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)] * self.single[lower(grams, 1).astype(np.int64)]
        p = p + _look(self.pairs, self.shares, lower(grams, 2), 0.0)
        for order, g, share, contexts, left in reversed(self.tables):
            own = lower(grams, order)
            p = _look(g, share, own, 0.0) + _look(contexts, left, own >> np.uint64(8), 1.0) * p
        return -np.log2(p)


class Model:
    """Trained tables under the shared folder: ``counts`` a row a shard and model, ``low`` a row a model; the number of shards and the models' names."""

    def __init__(self, docs: DataFrame, labels: DataFrame, work: Workspace):
        self.work, spark = work, docs.sparkSession
        good = trusted_ids(labels)
        small = good.count() <= MAX_BROADCAST_IDS
        self.good = F.broadcast(good) if small else good.hint("shuffle_hash")
        grams = work.table(_needed(docs).join(self.good, "doc_id", "left_semi").mapInArrow(_count, "m string, g long, c long").groupBy("m", "g").agg(F.sum("c").alias("c")), "ngrams")
        known = {r["m"] for r in grams.select("m").distinct().collect()}  # two rows a language
        langs = {r["lang"] or "" for r in _needed(docs).select("lang").distinct().collect()}
        if any(f"{fold}|{lang}" not in known for fold in (0, 1) for lang in langs):  # the models of all languages are needed
            pooled = grams.groupBy(F.substring_index("m", "|", 1).alias("m"), "g").agg(F.sum("c").alias("c"))
            known |= {m.split("|", 1)[0] for m in known}
            grams = work.table(grams.unionByName(pooled), "ngrams-pooled")
        self.known = frozenset(known)
        self.shards = 1 + grams.count() // SHARD_GRAMS
        dealt = grams.withColumn("s", shard_column(self.shards)).repartition(partitions(spark), "s", "m").sortWithinPartitions("s", "m", "g").select("s", "m", "g", "c")
        self.counts = work.table(dealt.mapInArrow(_shard_counts, COUNTS), "counts")
        pairs = self.counts.select("m", F.explode(F.arrays_zip("pairs", "before")).alias("p")).groupBy("m", F.col("p.pairs").alias("pair")).agg(F.sum("p.before").alias("before"))
        sums = [F.sum(F.col("of_counts")[4 * (ORDER - order) + i - 1]).alias(f"n{order}{i}") for order in range(ORDER, 2, -1) for i in (1, 2, 3, 4)]
        fitted = pairs.groupBy("m").cogroup(self.counts.groupBy("m").agg(*sums).groupBy("m")).applyInArrow(_fit_low, FITTED)
        self.low = work.table(fitted, "low")


# --- scores ----------------------------------------------------------------------------------------------------------------------------------

SCORED_BY = ("doc_id", "lang")
ASKED = "s int, m string, block long, n long, grams binary"


def _ask(known: frozenset[str], shards: int, limit: int) -> Callable:
    """The distinct n-grams that each block asks a shard of a model for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in row_blocks(batches, limit, SCORED_BY):
            grams = Distinct(counts=False)
            for rows, text in held:
                grams.add(text, settled(model_of(rows.column("doc_id"), rows.column("lang").cast(pa.string()), own=False), known))
            for m, g, _ in grams.pop():
                if m not in known:
                    continue
                shard = shard_of(g, m, shards)
                order = np.argsort(shard, kind="stable")
                g, shard = g[order], shard[order]
                cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                to = np.append(cut[1:], len(g))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cut].astype(np.int32)), pa.array([m] * len(cut)), pa.array([block] * len(cut), pa.int64()), pa.array(to - cut, pa.int64()), pa.array([pack(g[a:b]) for a, b in zip(cut, to, strict=True)], pa.binary())], ["s", "m", "block", "n", "grams"]
                )
        trim()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the n-grams that blocks ask for; rows come sorted by (shard, model, slice, kind): the counted shard, the low orders, then the questions."""
    now, low, counted, shard = None, None, None, None
    for batch in batches:
        for r in batch.to_pylist():
            if (r["s"], r["m"], r["slice"]) != now:
                now, low, counted, shard = (r["s"], r["m"], r["slice"]), None, None, None
            if r["kind"] == 0:
                counted = r
            elif r["kind"] == 1:
                low = r
            elif low is not None:
                shard = shard or Shard(low, counted)
                found = shard.bits(unpack(r["grams"], r["n"])).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["m"]]), pa.array([r["n"]], pa.int64()), pa.array([r["grams"]], pa.binary()), pa.array([found.tobytes()], pa.binary())], ["block", "m", "n", "grams", "bits"])


SCORED = "block long, blob binary, doc_id array<long>, lang array<string>, n_bytes array<long>, bits array<double>, worst array<double>"


def _score(known: frozenset[str], keep: bool) -> Callable:
    def score(blob: bytes, answers: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        table = pa.ipc.open_stream(blob).read_all()
        column = lambda x, t: pa.concat_arrays([c.cast(t) for c in table.column(x).chunks])
        ids, langs, text = column("doc_id", pa.int64()), column("lang", pa.string()), column("text", pa.string()).fill_null("")
        del table
        data, offsets = utf8_parts(text)
        size = np.diff(offsets)
        names, which = np.unique(np.array(settled(model_of(ids, langs, own=False), known), dtype=object), return_inverse=True)
        total, worst = np.zeros(len(size)), np.zeros(len(size))
        before = np.zeros(PASSAGE - 1)
        for lo, hi in slices(len(data)):
            key, row, into = ngram_keys(data, offsets, lo, hi)
            of, cost = which[row], np.full(hi - lo, np.nan)
            for i in np.unique(of).tolist():
                if names[i] in known:
                    here = of == i
                    asked, at = np.unique(key[here], return_inverse=True)
                    found = _look(*answers.get(names[i], (np.zeros(0, np.uint64), np.zeros(0, np.float32))), asked, np.nan)
                    if np.isnan(found).any():
                        raise RuntimeError("the documents were not read in one order twice: an n-gram has no answer")
                    cost[here] = found[at]
            total += np.bincount(row, cost, minlength=len(size))
            tail = np.concatenate([before, cost])
            passage = np.zeros(hi - lo)
            for back in range(PASSAGE):
                passage += np.where(into >= back, tail[PASSAGE - 1 - back : len(tail) - back], 0)
            before = tail[len(tail) - PASSAGE + 1 :]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            worst[row[first]] = np.maximum(worst[row[first]], np.maximum.reduceat(passage, first))
        bits, worst = (np.where(size > 0, x, np.nan) for x in (total / np.maximum(size, 1), worst / PASSAGE))
        return [ids, langs, pa.array(size), pa.array(bits, from_pandas=True), pa.array(worst, from_pandas=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows sorted by (block, m), nulls first: the block's rows (twice if two blocks are alike), then its answers
        for (block,), parts in runs(batches, ("block",)):
            rows = [r for p in parts for r in p.to_pylist()]
            blobs = [r["blob"] for r in rows if r["blob"] is not None]
            answers: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for m in {r["m"] for r in rows[len(blobs) :]}:
                own = [r for r in rows[len(blobs) :] if r["m"] == m]
                g, at = np.unique(np.concatenate([unpack(r["grams"], r["n"]) for r in own]), return_index=True)
                answers[m] = g, np.concatenate([np.frombuffer(r["bits"], np.float32) for r in own])[at]
            del rows, parts
            for blob in blobs:
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in score(blob, answers)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob if keep else None], pa.binary()), *lists], ["block", "blob", "doc_id", "lang", "n_bytes", "bits", "worst"])
            del answers, blobs
        trim()

    return run


def scored_blocks(docs: DataFrame, model: Model, keep: bool) -> DataFrame:
    """``SCORED``: a row a block of documents with its scores; with ``keep`` also the rows themselves. Reads ``docs`` twice."""
    work = model.work
    limit = BLOCK // 2 if keep else BLOCK  # blocks with all columns are kept, and read again
    packed = work.table(docs.mapInArrow(_ask(model.known, model.shards, limit), ASKED), "asked")
    # a row a shard and model that is asked: Spark sees the size of the written table and broadcasts it if it is small
    dealt = work.table(packed.groupBy("s", "m").agg(F.sum("n").alias("asked")).withColumn("slices", F.ceil(F.col("asked") / SLICE_GRAMS).cast("int")), "slices")
    n = max(partitions(docs.sparkSession), (dealt.agg(F.sum("asked")).first()[0] or 0) // TASK_GRAMS)
    none = lambda *names: [F.lit(None).cast(t).alias(x) for x, t in names]
    low = ("discounts", "pairs", "shares", "left", "single")
    copies = dealt.select("s", "m", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    counted = model.counts.join(copies, ["s", "m"]).select("s", "m", "slice", F.lit(0).alias("kind"), *none(("block", "long")), "n", "grams", "counts", *none(*((x, "binary") for x in low)))
    fitted = copies.join(model.low, "m").select("s", "m", "slice", F.lit(1).alias("kind"), *none(("block", "long"), ("n", "long"), ("grams", "binary"), ("counts", "binary")), *low)
    slice_ = F.pmod(F.xxhash64("block"), F.col("slices")).cast("int").alias("slice")
    asked = packed.join(dealt, ["s", "m"]).select("s", "m", slice_, F.lit(2).alias("kind"), "block", "n", "grams", *none(("counts", "binary"), *((x, "binary") for x in low)))
    met = counted.unionByName(fitted).unionByName(asked).repartition(n, "s", "m", "slice").sortWithinPartitions("s", "m", "slice", "kind")
    answers = met.mapInArrow(_answer, "block long, m string, n long, grams binary, bits binary").select("block", *none(("blob", "binary")), "m", "n", "grams", "bits")
    rows = packed_rows(docs, limit, SCORED_BY).select("block", "blob", *none(("m", "string"), ("n", "long"), ("grams", "binary"), ("bits", "binary")))
    return work.table(rows.unionByName(answers).repartition(n, "block").sortWithinPartitions("block", "m").mapInArrow(_score(model.known, keep), SCORED), "scored")


class Judge:
    """The scores of all rows of ``docs`` and the thresholds of trusted ones."""

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float = 0.99, min_trusted: int = 100, keep: bool = False):
        self.work = Workspace(docs.sparkSession, "perplexity")
        self.schema = docs.schema
        model = Model(docs, labels, self.work)
        self.scored = scored_blocks(docs if keep else _needed(docs), model, keep)
        rows = self.scored.select(F.explode(F.arrays_zip("doc_id", "lang", "n_bytes", "bits", "worst")).alias("r")).select("r.*")
        self.rows = rows
        cell = lambda x: F.floor(F.col(x) * GRAIN).alias(x)
        trusted = rows.where("bits is not null").join(model.good, "doc_id", "left_semi").select(F.coalesce("lang", F.lit("")).alias("lang"), length_band("n_bytes").alias("band"), cell("bits"), cell("worst"))
        at = [F.expr(f"percentile_disc({quantile}) within group (order by {x})").alias(x) for x in ("bits", "worst")]  # a value a thousandth of a bit is held at most
        found: list[dict] = []
        for by in (("lang", "band"), ("lang",), ("band",), ()):  # one row a group: languages x bands at most
            found.append({tuple(r[x] for x in by): r for r in trusted.groupBy(*by).agg(F.count("*").alias("n"), *at).collect()})
        self.limits: dict[str, list[tuple[float, float]]] = {}
        everything = found[3].get(())
        if everything is None or not everything["n"]:
            self.other = [(np.inf, np.inf)] * LENGTH_BANDS
            return

        def limit(lang: str | None, band: int) -> tuple[float, float]:
            choice = [found[0].get((lang, band)), found[1].get((lang,)), found[2].get((band,))]
            r = next((r for r in choice if r is not None and r["n"] >= min_trusted), everything)
            return (r["bits"] + 1) / GRAIN, (r["worst"] + 1) / GRAIN

        self.other = [limit(None, band) for band in range(LENGTH_BANDS)]
        self.limits = {lang: [limit(lang, band) for band in range(LENGTH_BANDS)] for (lang,) in found[1]}

    def _limit(self, which: int) -> Column:
        """The limit of a row with ``lang`` and ``n_bytes``: 0 of all bytes, 1 of the least likely passage."""
        other = F.lit([float(x[which]) for x in self.other])
        by_lang = F.create_map(*[x for lang, v in self.limits.items() for x in (F.lit(lang), F.lit([float(y[which]) for y in v]))]) if self.limits else None
        own = other if by_lang is None else F.coalesce(F.try_element_at(by_lang, F.coalesce("lang", F.lit(""))), other)
        return F.element_at(own, length_band("n_bytes") + 1)

    def report(self) -> DataFrame:
        """``doc_id, lang, n_bytes, perplexity, threshold, worst, worst_threshold, keep``: a row for each row of the documents."""
        power = lambda x: F.pow(F.lit(2.0), x)
        keep = F.coalesce((F.col("bits") <= self._limit(0)) & (F.col("worst") <= self._limit(1)), F.lit(True))
        return self.rows.select("doc_id", "lang", "n_bytes", power("bits").alias("perplexity"), power(self._limit(0)).alias("threshold"), power("worst").alias("worst"), power(self._limit(1)).alias("worst_threshold"), keep.alias("keep"))

    def keep(self) -> DataFrame:
        """The rows of the documents, all columns, that are not rejected (for a judge made with ``keep``)."""
        limits, other = self.limits, self.other

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    bits, worst = (np.array([np.nan if x is None else x for x in r[name]]) for name in ("bits", "worst"))
                    bands = length_bands(np.array(r["n_bytes"], np.int64))
                    limit = np.array([limits.get(x or "", other)[b] for x, b in zip(r["lang"], bands.tolist(), strict=True)]).reshape(-1, 2)
                    good = ~((bits > limit[:, 0]) | (worst > limit[:, 1]))
                    at = 0
                    for piece in pa.ipc.open_stream(r["blob"]):
                        yield piece.filter(pa.array(good[at : at + piece.num_rows]))
                        at += piece.num_rows

        return self.scored.select("blob", "lang", "n_bytes", "bits", "worst").mapInArrow(run, self.schema)


def quality_report(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, min_trusted: int = 100) -> DataFrame:
    """``doc_id, lang, n_bytes, perplexity, threshold, worst, worst_threshold, keep`` for every row of ``docs(doc_id, lang, text)``.

    Null texts are empty; empty texts have no perplexity and are kept; a text under ``PASSAGE`` bytes is one passage, its missing bytes costing
    nothing. Every other row is judged, unless the trusted documents are all in one fold, so that none has a held-out score, or there are none.
    Fewer than ``min_trusted`` trusted documents of a language and length take the threshold of their language, then of the length, then of all.
    Null languages count as the language '', null doc_ids as 0; repeated rows get equal scores; of several labels of a document the worst
    counts; a very long text is read in slices; an empty table gives no rows. Other columns are ignored.
    """
    return Judge(docs, labels, quantile, min_trusted).report()


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, min_trusted: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that ``quality_report`` keeps; its cases hold here too. Rows are carried whole, so none is joined back."""
    return Judge(docs, labels, quantile, min_trusted, keep=True).keep()
