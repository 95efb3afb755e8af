"""SimHash near-duplicates by a binary-trie self-join.

Every distinct fingerprint stands in a binary trie of its bits. Node pairs are walked together from (root, root): a pair of equal
bits keeps its count of differing bits, a pair of unlike bits adds one, and a pair beyond the error budget is dropped with all below.

Spark deals out the trie by zero-error prefixes. The 64 bits form ``budget + 2`` blocks; two fingerprints within the budget agree
on two whole blocks at least. So for each pair of blocks the fingerprint is rotated to have these two in front, and rows with one
such prefix meet in one task, which walks the trie below it. A prefix with more than ``node_cap`` fingerprints is dealt out one
block deeper, by pairs of trie nodes within the budget; below that, 2**16 fingerprints at most share a node.
A task yields a spanning forest of its links (same components, linear size), never the pairs of a group.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_slices, partitions, texts
from .components import connected_components

SEED = 42
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str, shingle: int) -> int:
    """Bit i is 1 if set in over half the XXH64 values of all word shingles, repeats included; 0 without words."""
    words = _WORDS.findall(text.encode().lower())  # bytes.lower() maps A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        hashes = [digest(line[a:b], SEED) for a, b in zip((end - size)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if set in over half of the 64-bit words."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp long`` (and the ``extra`` long columns) of every row of ``docs(doc_id, text)`` as ``texts`` gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch, "text", 1 << 22):
                found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text").slice(lo, hi - lo)], np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", *extra)), pa.array(found.view(np.int64))], ["doc_id", *extra, "fp"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *extra, "fp")))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(shift, bits) of the budget + 2 blocks."""
    edges = [64 * i // (budget + 2) for i in range(budget + 3)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def rotations(budget: int) -> list[list[tuple[int, int]]]:
    """For each pair of blocks, all blocks with that pair in front."""
    blocks = _blocks(budget)
    return [[*pair, *(b for b in blocks if b not in pair)] for pair in itertools.combinations(blocks, 2)]


def rotated(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for shift, bits in order:
        out = (out << np.uint64(bits)) | ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
    return out


def trie_pairs(keys: np.ndarray, roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], depth: int, budget: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct 64-bit ``keys`` within ``budget`` differing bits, below the given pairs of trie nodes.

    A node is a range of ``keys`` that agree on ``depth`` bits; a root is (lo, hi, lo2, hi2) arrays of node pairs with no error yet.
    Breadth first and vectorised; a frontier beyond ``limit`` pairs is walked in parts.
    """
    stack = [(depth, *(x.astype(np.int64) for x in r), np.zeros(len(r[0]), np.int64)) for r in roots]
    while stack:
        d, a, a2, b, b2, err = stack.pop()
        if len(a) > limit:
            half = len(a) // 2
            stack += [(d, *(x[:half] for x in (a, a2, b, b2, err))), (d, *(x[half:] for x in (a, a2, b, b2, err)))]
            continue
        small = (a2 - a) * (b2 - b) <= 4  # few leaves below: finish by counting bits
        if small.any():
            for i in range(4):
                for j in range(4):
                    ok = small & (a + i < a2) & (b + j < b2)
                    x, y = a[ok] + i, b[ok] + j
                    ok = (x < y) & (np.bitwise_count(keys[x] ^ keys[y]) <= budget)
                    if ok.any():
                        yield x[ok], y[ok]
            a, a2, b, b2, err = (x[~small] for x in (a, a2, b, b2, err))
        if not len(a) or d == 64:
            continue
        bit = np.uint64(63 - d)
        ones = (keys >> bit) & np.uint64(1)
        upto = np.append(0, np.cumsum(ones)).astype(np.int64)
        am, bm = a2 - (upto[a2] - upto[a]), b2 - (upto[b2] - upto[b])  # where the bit turns to 1
        same = (a == b) & (a2 == b2)
        children = []
        for x, x2, y, y2, e, keep in ((a, am, b, bm, err, None), (am, a2, bm, b2, err, None), (a, am, bm, b2, err + 1, None), (am, a2, b, bm, err + 1, ~same)):
            ok = (x < x2) & (y < y2) & (e <= budget)
            children.append([v[ok if keep is None else ok & keep] for v in (x, x2, y, y2, e)])
        stack.append((d + 1, *(np.concatenate(v) for v in zip(*children, strict=True))))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index linked to each of n indices."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            rx, ry = root[x], root[y]
            if (rx == ry).all():
                break
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (root[root] != root).any():
                root = root[root]
    return root


def _join_task(budget: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows sorted by (rotation, prefix, node): a whole group at a time; held back only until its prefix ends
        held: list[tuple[np.ndarray, ...]] = []
        names = ("rotation", "prefix", "node", "key", "fp", "guest")
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(tuple(np.asarray(batch.column(n)) for n in names))
                if sum(len(x[0]) for x in held) < 1 << 18:
                    continue
            if not held:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            new = np.append(True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) if len(cols[0]) else np.zeros(0, bool)
            cut = len(new) if batch is None else int(np.flatnonzero(new)[-1])
            held = [tuple(c[cut:] for c in cols)]
            cols = [c[:cut] for c in cols]
            if not cut:
                continue
            gid = np.cumsum(new[:cut]) - 1
            key, fp, guest = cols[3].astype(np.uint64), cols[4], cols[5].astype(bool)
            order = np.lexsort((key, guest, gid))
            gid, key, fp, guest = gid[order], key[order], fp[order], guest[order]
            # the walk works on one sorted array: home rows of all groups first by group, and guests after them by group
            lo = np.flatnonzero(np.append(True, np.diff(gid) != 0))
            hi = np.append(lo[1:], len(gid))
            mid = lo + np.add.reduceat(~guest, lo).astype(np.int64)
            inner = mid - lo > 1
            cross = (hi > mid) & (mid > lo)
            roots = [(lo[inner], mid[inner], lo[inner], mid[inner]), (lo[cross], mid[cross], mid[cross], hi[cross])]
            root = forest(len(key), trie_pairs(key, [r for r in roots if len(r[0])], depth, budget))
            got = np.flatnonzero(root != np.arange(len(key)))
            got = got[fp[got] != fp[root[got]]]
            yield pa.RecordBatch.from_arrays([pa.array(fp[got]), pa.array(fp[root[got]])], ["a", "b"])

    return run


def trie_links(distinct: DataFrame, work: Workspace, budget: int = 2, node_cap: int = 100_000) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that give the same components as all pairs within ``budget`` bits."""
    orders = rotations(budget)
    front = sum(bits for _, bits in orders[0][:2])
    if any(sum(b for _, b in o[:2]) != front for o in orders):
        raise ValueError("64 must divide into budget + 2 equal blocks")

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            for k, order in enumerate(orders):
                key = rotated(fp.view(np.uint64), order)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array((key >> np.uint64(64 - front)).view(np.int64)), pa.array(key.view(np.int64)), pa.array(fp)], ["rotation", "prefix", "key", "fp"])

    rows = distinct.select("fp").mapInArrow(rotate, "rotation int, prefix long, key long, fp long")
    sizes = rows.groupBy("rotation", "prefix").count().where("count > 1")
    large = work.table(sizes.where(F.col("count") > node_cap).select("rotation", "prefix"), "large-prefixes")
    home = rows.select("rotation", "prefix", F.lit(-1).alias("node"), "key", "fp", F.lit(False).alias("guest"))
    n = partitions(distinct.sparkSession)
    parts = [(home, front)]
    if not large.isEmpty():
        parts = [(home.join(large, ["rotation", "prefix"], "left_anti"), front)]
        bits = _blocks(budget)[0][1]
        node = F.shiftrightunsigned("key", 64 - front - bits).bitwiseAND((1 << bits) - 1).cast("int")
        masks = [sum(1 << i for i in c) for k in range(budget + 1) for c in itertools.combinations(range(bits), k)]
        deep = home.join(large, ["rotation", "prefix"]).withColumn("own", node)
        deep = deep.withColumn("node", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("own").bitwiseXOR(m)))).where("node <= own")
        parts.append((deep.withColumn("guest", F.col("node") < F.col("own")).drop("own"), front))
    links = [p.repartition(n, "rotation", "prefix", "node").sortWithinPartitions("rotation", "prefix", "node").select("rotation", "prefix", "node", "key", "fp", "guest").mapInArrow(_join_task(budget, depth), "a long, b long") for p, depth in parts]
    return links[0] if len(links) == 1 else links[0].unionByName(links[1])


def fingerprint_classes(fps: DataFrame, work: Workspace, budget: int, node_cap: int) -> DataFrame:
    """``fp, component``: every distinct fingerprint with the smallest one it reaches (as signed integers)."""
    distinct = work.table(fps.groupBy("fp").agg(F.count("*").alias("rows")), "distinct")
    component = connected_components(trie_links(distinct, work, budget, node_cap), work)
    return distinct.join(component.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, node_cap: int = 100_000) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id whose fingerprint can be reached over links of at most ``budget`` differing bits. Null texts
    are empty (fingerprint 0, linked like any other); null doc_ids keep their row and never name a component unless all of it is
    null. Repeated rows keep a row each; an empty table gives no rows. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "simhash")
    fps = work.table(fingerprints(texts(docs), shingle), "fingerprints")
    classes = work.table(fingerprint_classes(fps, work, budget, node_cap), "fingerprint-classes")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(classes, "fp").groupBy("component").agg(F.min("rep").alias("component_id"))
    table = work.table(classes.join(least, "component").select("fp", "component_id"), "classes")
    return fps.join(table, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
