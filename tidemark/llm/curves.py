"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected several times to a few random directions and shifted; each time its cell's place on a Hilbert curve is its key.
Spark range-partitions each ordering, so positions along a curve come from partition counts. A query is compared with all vectors in its
own and the two neighbouring key windows of each curve, by exact cosine, and the best of all curves are merged and reranked.

The window is measured, not guessed: for a bounded sample of queries (``calibration``) the true neighbours are found by brute force over
all vectors, and the window is the distance along the best curve that reaches ``recall`` of them. It grows where the data has no structure.

Equal vectors are one class on the curves, so a vector that a third of all rows share costs one place; its smallest ids are put back last.
Vectors of each length have curves of their own. The orderings carry ids only; vectors join them once positions are known. The best
``k + MARGIN`` found are scored again on the original vectors by one formula in a fixed order, so scores do not depend on how rows were batched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions

DIMS, BITS = 8, 8
MARGIN = 16
SCORES = 1 << 21  # scores held at once


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of integer points (n x d, ``bits`` bits a coordinate, d * bits <= 64), by Skilling's transform on columns."""
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def curve_keys(unit: np.ndarray, curve: int, seed: int) -> np.ndarray:
    """Signed 64-bit keys of unit vectors on one curve: random orthonormal directions, a random shift, then the Hilbert place."""
    dim = unit.shape[1]
    rng = np.random.default_rng((seed, curve, dim))
    directions = np.linalg.qr(rng.normal(size=(dim, min(DIMS, dim))))[0]
    reach = 4 / np.sqrt(dim)
    place = (unit @ directions + reach) / (4 * reach) + rng.random(directions.shape[1]) / 2  # half the grid, anywhere in it
    cells = np.clip(place * (1 << BITS), 0, (1 << BITS) - 1)
    return (hilbert_keys(cells, BITS) ^ np.uint64(1 << 63)).view(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<float> or list<double> column of equal lengths, in double precision."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row, ties to smaller ids; columns of ids belong to scores."""
    if scores.shape[1] > 4 * k:
        floor = np.partition(scores, -k, axis=1)[:, -k]
        keep = (scores >= floor[:, None]).sum(axis=1).max()
        part = np.argpartition(-scores, min(keep, scores.shape[1]) - 1, axis=1)[:, :keep]
        scores, ids = np.take_along_axis(scores, part, 1), np.take_along_axis(ids, part, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _rows(query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    ok = np.isfinite(scores)
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(query[:, None], ids.shape)[ok]), pa.array(ids[ok]), pa.array(scores[ok])], ["query", "id", "score"])


FOUND = "query long, id long, score double"


def _add(units: np.ndarray, names: np.ndarray, best: np.ndarray, ids: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """The best of what was held and of some more vectors, in pieces of bounded size; ``itself``: whether a query may find its own id."""
    step = max(1, SCORES // max(1, len(units)))
    for lo in range(0, len(own), step):
        score = units @ unit_rows(vectors[lo : lo + step]).T
        if not itself:
            score[names[:, None] == own[lo : lo + step]] = -np.inf
        best, ids = _best(np.hstack([best, score]), np.hstack([ids, np.broadcast_to(own[lo : lo + step], score.shape)]), k)
    return best, ids


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) of the lists of a column."""
    size = np.diff(np.asarray(column.offsets))
    for n in np.unique(size).tolist():
        yield n, np.flatnonzero(size == n)


def exact_neighbours(queries: list[tuple[int, list[float]]], vectors: DataFrame, k: int) -> DataFrame:
    """``query, id, score``: for a bounded list of queries, the k best of each partition of ``vectors(id, embedding)``; merge by the caller."""
    groups = {n: ([q for q, v in queries if len(v) == n], [v for _, v in queries if len(v) == n]) for n in {len(v) for _, v in queries}}
    state = {n: (np.array(q, np.int64), unit_rows(np.array(v, np.float64))) for n, (q, v) in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: (np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)) for n, (q, _) in state.items()}
        for batch in batches:
            for n, rows in by_length(batch.column("embedding")):
                if n in state:
                    own, vectors = np.asarray(batch.column("id"))[rows], matrix(batch.column("embedding").take(pa.array(rows)))
                    held[n] = _add(state[n][1], state[n][0], *held[n], own, vectors, k, False)
        for n, (best, ids) in held.items():
            yield _rows(state[n][0], ids, best)

    return vectors.select("id", "embedding").mapInArrow(run, FOUND)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows sorted by (dim, curve, window, candidate): the queries of a window come first, then its vectors stream by
        names = units = best = ids = None
        now, asked = None, []

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None and best.shape[1]:
                yield _rows(names, ids, best)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(x)).astype(np.int64) for x in ("dim", "curve", "window", "candidate")]
            new = np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0))
            for lo, hi in itertools.pairwise([*np.flatnonzero(new).tolist(), batch.num_rows]):
                here = tuple(int(c[lo]) for c in cols[:3])
                if here != now:
                    yield from result()
                    now, asked, best = here, [], None
                id_, vec = np.asarray(batch.column("id"))[lo:hi], matrix(batch.column("embedding").slice(lo, hi - lo))
                if not cols[3][lo]:
                    asked.append((id_, unit_rows(vec)))
                    continue
                if not asked:
                    continue
                if best is None:
                    names, units = np.concatenate([x for x, _ in asked]), np.concatenate([x for _, x in asked])
                    best, ids = np.full((len(names), 0), -np.inf), np.zeros((len(names), 0), np.int64)
                best, ids = _add(units, names, best, ids, id_, vec, k, True)
        yield from result()

    return run


def valid_vectors(df: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (array<float> or array<double>) of rows with an id and a finite non-zero vector."""
    kind = df.schema["embedding"].dataType.simpleString()
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)


def scaled(x: Column) -> Column:
    """A non-zero vector times a power of two (by halves, each representable) that brings its largest component near 1, so that no square leaves the range of doubles. Exact."""
    half = F.pow(F.lit(2.0), -F.floor(F.log2(F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))) / 2).cast("double"))
    return F.transform(x, lambda v: v.cast("double") * half * half)


def cosine(a: str, b: str) -> Column:
    """dot / (norm x norm) of two array columns, each sum from the first component to the last, in double precision."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    return F.try_divide(dot(F.col(a), F.col(b)), F.sqrt(dot(F.col(a), F.col(a))) * F.sqrt(dot(F.col(b), F.col(b))))


def nearest(df: DataFrame, every: int = 50, k: int = 5, curves: int = 16, recall: float = 0.96, calibration: int = 256, seed: int = 7, window: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for every row whose vec_id is divisible by ``every``.

    Candidates are all rows of the query's vector length but its own; nearness is the cosine of the original vectors in double precision,
    ties to the smaller vec_id. Vectors that are null, zero or hold null or non-finite components take no part; rows of one
    vec_id are one row (of unlike vectors the one of least hash); with fewer than k candidates all are returned; an empty table gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    work = Workspace(spark, "curves")
    n = partitions(spark)
    # a class is a vector; 128 bits of hash name it
    rows = valid_vectors(df).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    array = rows.schema["embedding"].dataType.simpleString()
    ids = work.table(rows.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("h.h1", "h.h2", "vec_id"), "ids")
    by_class = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = work.table(ids.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1).drop("r"), "members")
    reps = rows.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding")).join(ids.groupBy("h1", "h2").agg(F.min("vec_id").alias("id")), ["h1", "h2"])
    reps = work.table(reps.select("h1", "h2", "id", "embedding"), "classes")
    asked = work.table(ids.where(F.col("vec_id") % every == 0).join(reps.select("h1", "h2", "id"), ["h1", "h2"]).select(F.col("vec_id").alias("query"), "id"), "queries")
    asked_ids = asked.select("id").distinct()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in by_length(batch.column("embedding")):
                unit, own = unit_rows(matrix(batch.column("embedding").take(pa.array(at)))), batch.column("id").take(pa.array(at))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), c, np.int32)), pa.array(curve_keys(unit, c, seed)), own], ["dim", "curve", "key", "id"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            d, c = np.asarray(batch.column("dim")), np.asarray(batch.column("curve"))
            new = np.append(True, (c[1:] != c[:-1]) | (d[1:] != d[:-1]))[: len(c)]
            for lo, hi in itertools.pairwise([*np.flatnonzero(new).tolist(), len(c)]):
                at = seen.get((int(d[lo]), int(c[lo])), 0)
                seen[int(d[lo]), int(c[lo])] = at + hi - lo
                piece = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([piece.column("dim"), piece.column("curve"), pa.array(np.full(hi - lo, part, np.int32)), pa.array(np.arange(at, at + hi - lo)), piece.column("id")], ["dim", "curve", "part", "at", "id"])

    order = ["dim", "curve", "key", "id"]
    lines = reps.select("id", "embedding").mapInArrow(keyed, "dim int, curve int, key long, id long").repartitionByRange(n, *order).sortWithinPartitions(*order)
    lines = work.table(lines.mapInArrow(numbered, "dim int, curve int, part int, at long, id long"), "orderings")
    counts = lines.groupBy("dim", "curve", "part").count()  # partitions + curves x lengths rows at most
    base = counts.select("dim", "curve", "part", F.coalesce(F.sum("count").over(Window.partitionBy("dim", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = lines.join(F.broadcast(base), ["dim", "curve", "part"]).withColumn("at", F.col("at") + F.col("base")).drop("part", "base")

    if window is None:
        sample = asked_ids.orderBy(F.xxhash64("id"), "id").limit(calibration).join(reps, "id").select("id", "embedding").collect()
        window = 1
        if sample:
            true = exact_neighbours([(r["id"], r["embedding"]) for r in sample], reps, k)
            best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
            pairs = [(r["query"], r["id"]) for r in true.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).collect()]
            wanted = spark.createDataFrame([(i,) for i in sorted({x for p in pairs for x in p})], "id long")  # calibration x (k + 1) ids at most
            places = {(r["curve"], r["id"]): r["at"] for r in placed.select("curve", "at", "id").join(F.broadcast(wanted), "id").collect()}
            gaps = sorted(min(abs(places[c, q] - places[c, i]) for c in range(curves)) for q, i in pairs)
            window = max(64, gaps[min(len(gaps) - 1, int(recall * len(gaps)))]) if gaps else 1
    placed = placed.withColumn("window", F.floor(F.col("at") / F.lit(window)))
    around = placed.join(asked_ids, "id", "left_semi").select("dim", "curve", F.explode(F.array(F.col("window") - 1, F.col("window"), F.col("window") + 1)).alias("window"), "id")
    met = placed.select("dim", "curve", "window", F.lit(True).alias("candidate"), "id").unionByName(around.select("dim", "curve", "window", F.lit(False).alias("candidate"), "id"))
    met = met.join(reps.select("id", "embedding"), "id").select("dim", "curve", "window", "candidate", "id", "embedding")
    met = met.repartition(n, "dim", "curve", "window").sortWithinPartitions("dim", "curve", "window", "candidate")
    found = met.mapInArrow(_search(k + 1 + MARGIN), FOUND).groupBy("query", "id").agg(F.max("score").alias("score"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1 + MARGIN)
    found = work.table(found.select(F.col("query").alias("q_class"), F.col("id").alias("n_class")), "found")
    vectors = lambda name: reps.select(F.col("id").alias(f"{name}_class"), F.col("embedding").cast(array).alias(f"{name}_vector"))
    found = found.join(vectors("q"), "q_class").join(vectors("n"), "n_class").withColumns({f"{x}_vector": scaled(F.col(f"{x}_vector")) for x in "qn"})
    found = found.select("q_class", "n_class", cosine("q_vector", "n_vector").alias("score"))
    # back from classes to rows: each class brings its k + 1 smallest ids
    with_ids = members.join(reps.select("h1", "h2", F.col("id").alias("n_class")), ["h1", "h2"]).select("n_class", "vec_id")
    out = asked.select(F.col("query").alias("query_id"), F.col("id").alias("q_class")).join(found, "q_class").join(with_ids, "n_class").where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
