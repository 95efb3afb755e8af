"""Near-duplicates by Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands propose, exact set comparison decides.

1. Equal sets are one class by their digest. Each distinct set has a SimHash fingerprint; operator 2's binary-trie self-join groups those that reach
   each other over at most ``BUDGET`` differing bits, and the sets of a group are compared exactly. The links give components.
2. No budget of a trie covers a similarity of 0.8: on sf0.1 such pairs differ in 4 to 14 of 64 bits, and tries that cover 14 visit nearly all
   pairs. So what the trie leaves apart is proposed by MinHash bands: a band of ``ROWS`` minima agrees with probability similarity ** ROWS, so at
   0.8 a pair misses all ``BANDS`` bands with probability 7e-5, and less above. Buckets within one component of step 1 are settled and skipped;
   buckets with the same members meet once.

A bucket yields links with the same components as all its pairs at the similarity, never the pairs of a group. Buckets of at most ``BUCKET``
sets are a task each. In larger ones every set is compared with the bucket's first; only those not linked to it are compared with the whole
bucket, dealt out in pairs of parts of at most ``BUCKET`` sets, so no task holds more, however many copies a text has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, Workspace, byte_slices, mix64, packed_rows, partitions, row_blocks, span_hashes, texts, trim
from .components import connected_components
from .simhash import fingerprint_classes, majority

SHINGLE = 5
SIMILARITY = (4, 5)  # as a fraction, so that the comparison is exact
BUDGET = 6  # differing bits of 64; budget + 2 must divide 64
BANDS, ROWS = 24, 5
MAX_BROADCAST_IDS = 500_000
BUCKET = 2048
BLOCK = 4 << 20  # bytes of text of a block of rows
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_MULTIPLIERS = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1)


def shingle_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a string column without nulls, repeats included, and where each row's begin (n + 1 places).

    Words are lower-case (A-Z) and joined by a space; a text shorter than a shingle is one, a text without words has none.
    """
    lines, starts, ends, counts = [], [], [], []
    at = 0
    for text in column:
        words = _WORDS.findall(text.as_py().encode().lower())
        n = min(len(words), max(1, len(words) - shingle + 1))
        counts.append(n)
        if not n:
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        starts.append(at + (end - size)[:n])
        ends.append(at + end[-n:])
        lines.append(b" ".join(words))
        at += len(lines[-1])
    where = np.append(0, np.cumsum(counts)).astype(np.int64)
    if not lines:
        return np.zeros(0, np.uint64), where
    return span_hashes(np.frombuffer(b"".join(lines), np.uint8), np.concatenate(starts), np.concatenate(ends)), where


def band_hashes(hashes: np.ndarray, where: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes a row (rows by bands) of MinHash signatures; rows without shingles are zero."""
    out = np.zeros((len(where) - 1, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(where))
    if not len(some):
        return out
    starts = where[some]
    for b in range(BANDS):
        mixed = np.full(len(some), b, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            a, c = _MULTIPLIERS[:, k]
            mixed = mix64(mixed ^ np.minimum.reduceat((hashes ^ c) * (a | np.uint64(1)), starts)) + np.uint64(k)
        out[some, b] = mixed
    return out


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``block, at, doc_id, th, sk, fp, bands``: place, text hash, digest, fingerprint and band hashes of the shingle set of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in row_blocks(batches, BLOCK):
            first = 0
            for rows, text in held:
                ids = rows.column("doc_id").cast(pa.int64())
                for lo, hi in byte_slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", SLICE):
                    part = text.slice(lo, hi - lo)
                    hashes, where = shingle_hashes(part, shingle)
                    digest, fp = [], []
                    for a, b in zip(where[:-1], where[1:], strict=True):
                        own = np.unique(hashes[a:b])
                        digest.append(xxhash.xxh64_intdigest(own.tobytes()))
                        fp.append(majority(own))
                    th = [xxhash.xxh64_intdigest(x.as_py()) for x in part]
                    bands = band_hashes(hashes, where).view(np.int64).ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(bands))
                    numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (th, digest, fp)]
                    place = [pa.array(np.full(hi - lo, block)), pa.array(np.arange(first + lo, first + hi, dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays([*place, ids.slice(lo, hi - lo), *numbers, lists], ["block", "at", "doc_id", "th", "sk", "fp", "bands"])
                first += rows.num_rows
        trim()

    return docs.mapInArrow(run, "block long, at int, doc_id long, th long, sk long, fp long, bands array<long>")


def similar_links(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """For each of the distinct sets (sorted hashes) a set of its group: the components of all pairs at ``similarity`` or more.

    A pass compares one set with all others. First every set not yet linked makes one; then all sets outside the largest group: a link
    between two groups has an end there.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    tokens, starts = np.concatenate(sets), np.append(0, np.cumsum(size)[:-1])
    group, passed = np.arange(n), np.zeros(n, bool)
    num, den = similarity

    def compare(i: int) -> None:
        at = np.minimum(np.searchsorted(sets[i], tokens), size[i] - 1)
        shared = np.add.reduceat((sets[i][at] == tokens).astype(np.int64), starts)
        passed[i] = True
        linked = np.unique(group[shared * den >= (size + size[i] - shared) * num])
        group[np.isin(group, linked)] = linked[0]

    joined = np.zeros(n, bool)
    for i in range(n):
        if not joined[i]:
            compare(i)
            joined |= group == group[i]
    values, counts = np.unique(group, return_counts=True)
    for i in np.flatnonzero(~passed & (group != values[np.argmax(counts)])):
        compare(int(i))
    return group


def _links(groups: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``a, b``: links of each group of ``groups(part, sk, hashes)``, at most ``BUCKET`` sets each (or twice that, of two parts)."""

    def link(bucket: pa.Table) -> pa.Table:
        keys, first = np.unique(np.asarray(bucket.column("sk")), return_index=True)
        blobs = bucket.column("hashes").take(pa.array(first)).to_pylist()
        kept = np.flatnonzero([len(x) > 0 for x in blobs])
        group = similar_links([np.frombuffer(blobs[i], np.uint64) for i in kept], similarity) if len(kept) else np.zeros(0, np.int64)
        keys = keys[kept]
        far = group != np.arange(len(group))
        return pa.table({"a": pa.array(keys[far], pa.int64()), "b": pa.array(keys[group[far]], pa.int64())})

    return groups.groupBy("part").applyInArrow(link, "a long, b long")


def _near(similarity: tuple[int, int]):
    """Of rows (sk, first, hashes, first_hashes): whether the two sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = similarity
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("hashes").to_pylist(), batch.column("first_hashes").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near[i] = shared > 0 and shared * den >= (len(x) + len(y) - shared) * num
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "sk", "first")), pa.array(near)], ["bucket", "sk", "first", "near"])

    return run


def _bucket_links(members: DataFrame, tokens: DataFrame, work: Workspace, similarity: tuple[int, int], name: str) -> DataFrame:
    """``a, b``: links of all buckets of ``members(bucket, n, first, sk)``, whose sets are ``tokens(sk, hashes)``."""
    links = [_links(members.where(F.col("n") <= BUCKET).join(tokens, "sk").select(F.col("bucket").alias("part"), "sk", "hashes"), similarity)]
    large = members.where(F.col("n") > BUCKET)
    if not large.isEmpty():
        parts = F.ceil(F.col("n") / BUCKET).cast("long")
        slot = F.pmod(F.xxhash64("sk"), parts)
        firsts = large.select("first", "n").groupBy("first").agg(F.max("n").alias("n")).select(F.col("first").alias("f"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("f_slot"))
        firsts = firsts.join(tokens.select(F.col("sk").alias("f"), F.col("hashes").alias("first_hashes")), "f")
        dealt = large.withColumn("slot", slot).join(tokens, "sk")
        led = dealt.join(firsts, (F.col("first") == F.col("f")) & (F.col("slot") == F.col("f_slot"))).select("bucket", "sk", "first", "hashes", "first_hashes")
        led = work.table(led.mapInArrow(_near(similarity), "bucket long, sk long, first long, near boolean"), f"{name}-led")
        links.append(led.where("near and sk <> first").select(F.col("sk").alias("a"), F.col("first").alias("b")))
        apart = led.where("not near").select("bucket", "sk")
        lonely = apart.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET).cast("long").alias("lonely"))
        sized = large.select("bucket", F.ceil(F.col("n") / BUCKET).cast("long").alias("all")).distinct().join(lonely, "bucket")
        upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
        few = apart.join(sized, "bucket").select("bucket", F.pmod(F.xxhash64("sk"), F.col("lonely")).alias("i"), F.explode(upto("all")).alias("j"), "sk")
        rest = large.join(sized, "bucket").select("bucket", F.explode(upto("lonely")).alias("i"), F.pmod(F.xxhash64(F.lit(1), "sk"), F.col("all")).alias("j"), "sk")
        met = few.unionByName(rest).join(tokens, "sk").select(F.xxhash64("bucket", "i", "j").alias("part"), "sk", "hashes")
        links.append(_links(met, similarity))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return work.table(every.distinct(), f"{name}-links")


def trie_members(distinct: DataFrame, work: Workspace, budget: int, node_cap: int = 100_000) -> DataFrame:
    """``bucket, n, first, sk``: the sets of ``distinct(sk, fp)`` in groups whose fingerprints reach each other over at most ``budget`` differing bits."""
    classes = work.table(fingerprint_classes(distinct.select("fp"), work, budget, node_cap), "fingerprint-classes")
    placed = distinct.select("sk", "fp").join(classes, "fp").select("sk", F.xxhash64(F.lit("trie"), "component").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("sk").alias("first")).where("n > 1")
    return work.table(placed.join(sizes, "bucket").select("bucket", "n", "first", "sk"), "trie-members")


def band_members(distinct: DataFrame, work: Workspace) -> DataFrame:
    """``bucket, n, first, sk``: the sets of ``distinct(sk, bands)`` that share a band; buckets with the same members are one."""
    bands = distinct.select("sk", F.posexplode("bands").alias("band", "h"))
    buckets = bands.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("sk").alias("least"), F.sum(F.xxhash64("sk").cast("decimal(38,0)")).alias("members")).where("n > 1")
    once = work.table(buckets.groupBy("n", "least", "members").agg(F.min(F.struct("band", "h")).alias("bucket")).select("bucket.band", "bucket.h", "n", F.col("least").alias("first"), F.xxhash64("bucket").alias("bucket")), "buckets")
    return work.table(bands.join(once, ["band", "h"]).select("bucket", "n", "first", "sk"), "band-members")


def set_classes(docs: DataFrame, rows: DataFrame, work: Workspace, shingle: int, similarity: tuple[int, int], budget: int = BUDGET) -> DataFrame:
    """``sk, component``: every distinct shingle set with the smallest digest it reaches over links of at least ``similarity``."""
    distinct = work.table(rows.groupBy("sk").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "distinct-sets")
    by_trie, by_band = trie_members(distinct, work, budget), band_members(distinct, work)
    wanted = work.table(distinct.join(by_trie.select("sk").unionByName(by_band.select("sk")).distinct(), "sk", "left_semi").select("sk", F.col("of.doc_id").alias("of_id"), F.col("of.th").alias("of_th")), "wanted")
    small = wanted.select("sk", "of_id")
    small = F.broadcast(small) if wanted.count() <= MAX_BROADCAST_IDS else small.hint("shuffle_hash")
    found = texts(docs).join(small, F.col("doc_id").eqNullSafe(F.col("of_id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch, "text", SLICE):
                hashes, where = shingle_hashes(batch.column("text").slice(lo, hi - lo), shingle)
                own = [np.unique(hashes[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)]
                digest = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in own], np.uint64).view(np.int64)
                good = np.flatnonzero(digest == np.asarray(batch.column("sk").slice(lo, hi - lo)))  # of rows with one doc_id, the one meant
                yield pa.RecordBatch.from_arrays([pa.array(digest[good]), pa.array([own[i].tobytes() for i in good], pa.binary())], ["sk", "hashes"])
        trim()

    tokens = work.table(found.select("sk", "text").mapInArrow(sets, "sk long, hashes binary").dropDuplicates(["sk"]), "sets")
    links = _bucket_links(by_trie, tokens, work, similarity, "trie")
    near = work.table(connected_components(links, work), "trie-components").select(F.col("node").alias("sk"), F.col("component").alias("near"))
    # buckets of one component of the trie's links cannot join anything
    placed = by_band.join(near, "sk", "left").withColumn("near", F.coalesce("near", "sk"))
    open_ = placed.groupBy("bucket").agg(F.min("near").alias("a"), F.max("near").alias("b")).where("a < b").select("bucket")
    left = work.table(by_band.join(open_, "bucket", "left_semi"), "open-members")
    links = links.unionByName(_bucket_links(left, tokens, work, similarity, "band"))
    component = connected_components(links, work)
    return distinct.join(component.select(F.col("node").alias("sk"), "component"), "sk", "left").select("sk", F.coalesce("component", "sk").alias("component"))


def keep_similar(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, of which one stays for each group: the one of smallest doc_id (nulls last), then
    text hash, then place.

    Groups are the components of all pairs whose shingle sets have at least ``similarity`` (a fraction); texts without words are one group, null
    texts are empty, repeated rows are copies, a very long text is one set, an empty table gives no rows. ``docs`` is read three times and
    must give its rows in one order, as a table does; rows travel once, packed.
    """
    work = Workspace(docs.sparkSession, "similar")
    rows = work.table(signatures(docs, shingle), "signatures")  # all columns, so that both reads are the same plan
    classes = set_classes(docs, rows, work, shingle, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "block", "at")
    first = rows.groupBy("sk").agg(F.min(order).alias("first")).join(classes, "sk").groupBy("component").agg(F.min("first").alias("first"))
    stay = work.table(first.select("first.block", "first.at"), "stay")
    told = stay.groupBy("block").agg(F.collect_list("at").alias("stays")).select("block", F.lit(None).cast("binary").alias("blob"), "stays")
    both = packed_rows(docs, BLOCK).select("block", "blob", F.lit(None).cast("array<int>").alias("stays")).unionByName(told)
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows sorted by (block, blob), nulls first: what stays of a block, then its rows (blocks alike: the first one)
        now, stays, done = None, None, False

        def settle() -> None:
            if stays is not None and not done:
                raise RuntimeError("the documents were not read in one order twice: a block is missing")

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != now:
                    settle()
                    now, stays, done = r["block"], None, False
                if r["blob"] is None:
                    stays = np.sort(np.array(r["stays"], np.int64))
                elif stays is not None and not done:
                    done, at = True, 0
                    for piece in pa.ipc.open_stream(r["blob"]):
                        own = stays[(stays >= at) & (stays < at + piece.num_rows)] - at
                        if len(own):
                            yield piece.take(pa.array(own))
                        at += piece.num_rows
        settle()
        trim()

    n = partitions(docs.sparkSession)
    return both.repartition(n, "block").sortWithinPartitions("block", F.col("blob").isNotNull()).mapInArrow(keep, schema)
