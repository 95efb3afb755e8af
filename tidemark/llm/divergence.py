"""Audit of how sources differ in their terms: exact integer divergences between all sources of a language, and each source's most overused terms.

1. Tasks count terms by (lang, source) and hand over one row a term; a shuffle sums them.
2. Kept terms fall into blocks by hash, groups into blocks by order. A tile is one block of terms and two blocks of groups as dense ``int64``
   matrices, group by term; the divergences of all its pairs are computed by broadcasting one row at a time against the other matrix.
3. Tiles hand over partial sums of their pairs, and the best terms of each group (a heap of ten a tile); sums are added, heaps merged.

What a tile adds for a pair is the excess over the value of a term that neither group has, so terms that occur in neither need no cell.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, trim

UNIT = 1_000_000_000
FLUSH = 400_000  # distinct terms that a task holds before it hands them over
PIECE = 1 << 20  # bytes of one text that are split at once
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"


def pieces(raw: bytes, limit: int) -> Iterator[bytes]:
    """Parts of about ``limit`` bytes of a text whose terms are apart by spaces; no term is cut."""
    at = 0
    while len(raw) - at > limit:
        cut = raw.find(b" ", at + limit)
        if cut < 0:
            break
        yield raw[at:cut]
        at = cut
    yield raw[at:] if at else raw


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a task; every group also gives a row without a term."""
    uses: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def hand_over() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in uses.items():
            terms = [None, *(t.decode() for t in n)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        uses.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            held += (lang, source) not in uses
            n, docs = uses.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for part in pieces(text.encode().translate(TERM_BYTES), PIECE):
                words = part.split()
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n) - before
            if held > FLUSH:
                yield from hand_over()
                held = 0
    yield from hand_over()
    trim()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group; a row with a null term for each group."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return plain.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total) without leaving 64 bits: long division, three digits at a time (totals below 9 * 10^15; 0 only if there are no terms)."""
    total = np.maximum(total, 1)
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


TILE = "lang string, i int, j int, b int, part string, g int, h int, term string, value long"


def _tile(width: int, top: int):
    """One tile's rows: the excess of each pair of groups g < h, and on the diagonal each group's best terms."""

    def run(table: pa.Table) -> pa.Table:
        lang, i, j, b = (table.column(c)[0].as_py() for c in ("lang", "i", "j", "b"))
        g, total, count = (table.column(c).to_numpy() for c in ("g", "total", "n"))
        control = np.asarray(table.column("term").is_null())  # a row for each group of the tile, and of the language's sums at g = -1
        groups, at = np.unique(g[control], return_index=True)
        totals = total[control][at]
        terms = table.column("term").filter(pa.array(~control)).cast(pa.binary()).to_pylist()
        names = sorted(set(terms))
        place = {t: k for k, t in enumerate(names)}
        dense = np.zeros((len(groups), len(names)), np.int64)
        dense[np.searchsorted(groups, g[~control]), np.fromiter((place[t] for t in terms), np.int64, len(terms))] = count[~control]
        p, floor = shares(dense, totals[:, None]), shares(np.zeros(len(groups), np.int64), totals)
        out: dict[str, list] = {c: [] for c in ("part", "g", "h", "term", "value")}

        def add(part: str, g: np.ndarray, h: np.ndarray, term: list, value: np.ndarray) -> None:
            for c, x in (("part", [part] * len(g)), ("g", g.tolist()), ("h", h.tolist()), ("term", term), ("value", value.tolist())):
                out[c] += x

        rows = np.flatnonzero(groups >= 0)
        left, right = rows[groups[rows] // width == i], rows[groups[rows] // width == j]
        for x in left:
            y = right[groups[right] > groups[x]]
            if len(y):
                add("pair", np.full(len(y), groups[x]), groups[y], [None] * len(y), gaps(p[x], p[y]).sum(axis=1) - len(names) * gaps(floor[x], floor[y]))
        if i == j and len(names):
            for x in left:
                over = np.flatnonzero((dense[x] > 0) & (p[x] > p[0]))
                value = gaps(p[x, over], p[0, over])
                best = np.lexsort((over, -value))[:top]  # names are in byte order
                add("term", np.full(len(best), groups[x]), np.full(len(best), -1), [names[k].decode() for k in over[best]], value[best])
        n = len(out["g"])
        return pa.table([pa.array([lang] * n, pa.string()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array([b] * n, pa.int32()), pa.array(out["part"], pa.string()), pa.array(out["g"], pa.int32()), pa.array(out["h"], pa.int32()), pa.array(out["term"], pa.string()), pa.array(out["value"], pa.int64())], ["lang", "i", "j", "b", "part", "g", "h", "term", "value"])

    return run


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, tile_terms: int = 4096, tile_groups: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each (lang, source) group is from the other sources of its language, and by which terms.

    A language keeps the V terms found in ``min_docs`` or more of its documents. A group's share of a term is 1 + floor(10^9 (count + 2) / (N + 2 V));
    a language's likewise. Part ``pair``: for each other source of the language the sum over its terms of floor((p - q)^2 / (p + q)), all ranks.
    Part ``term``: the ``top`` terms that the group has and uses more than its language, by the same measure. Ties rank in byte order.

    Null texts, langs and sources are ''; repeated rows count as often as they come; a text of any length is split in pieces; groups without kept
    terms take part in pairs; a language without kept terms has divergences of 0; an empty table gives no rows; other columns are ignored.
    A task holds one tile: ``tile_terms`` terms (about) by twice ``tile_groups`` groups. Sums hold up to 9 * 10^15 terms a language.
    """
    work = Workspace(docs.sparkSession, "divergence")
    counts = work.table(term_counts(docs), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs)
    kept = work.table(kept.select("lang", "term", "n"), "kept")
    langs = kept.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    hits = work.table(counts.where("term is not null").join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "hits")
    groups = counts.where("term is null").select("lang", "source").join(hits.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left")
    groups = groups.join(langs, F.col("lang") == F.col("l"), "left")
    v = F.coalesce("v", F.lit(0))
    groups = groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"), v.alias("v"), (F.coalesce("own", F.lit(0)) + 2 * v).alias("total"), (F.coalesce("all", F.lit(0)) + 2 * v).alias("lang_total"))
    groups = work.table(groups, "groups")
    sides = groups.groupBy("lang").agg((F.floor(F.max("g") / tile_groups) + 1).cast("int").alias("sides"), F.greatest(F.ceil(F.max("v") / tile_terms), F.lit(1)).cast("int").alias("blocks"), F.max("lang_total").alias("lang_total"))
    sides = work.table(sides, "sides")
    names = {c: F.col(c) for c in ("lang", "g", "total", "term", "n")}

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows of a group go to every tile that its block of groups is a side of."""
        own = F.floor(F.col("g") / tile_groups).cast("int")
        each = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, sides - 1)")))
        return each.select(*names.values(), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "b")

    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    tallies = hits.join(groups.select("lang", "source", "g", "total"), ["lang", "source"]).join(sides, "lang").withColumn("b", block)
    every_block = F.explode(F.expr("sequence(0, blocks - 1)")).alias("b")
    none = (F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    control = groups.join(sides.select("lang", "sides", "blocks"), "lang").select("lang", "g", "total", *none, "sides", every_block)
    # the language's own sums stand at g = -1 in the tiles of one block with itself
    whole = F.explode(F.expr("sequence(0, sides - 1)")).alias("i")
    lang_terms = kept.join(sides, "lang").withColumn("b", block).select("lang", F.lit(-1).alias("g"), F.col("lang_total").alias("total"), "term", "n", "b", whole).withColumn("j", F.col("i"))
    lang_control = sides.select("lang", F.lit(-1).alias("g"), F.col("lang_total").alias("total"), *none, "sides", every_block).select(*names, "b", whole).withColumn("j", F.col("i"))
    cells = dealt(tallies).unionByName(dealt(control)).unionByName(lang_terms).unionByName(lang_control)
    tiles = work.table(cells.groupBy("lang", "i", "j", "b").applyInArrow(_tile(tile_groups, top), TILE), "tiles")

    # every pair of a language's groups stands in each of its tiles: the floor for all V terms, and what the tiles add
    sums = tiles.where("part = 'pair'").groupBy("lang", "g", "h").agg(F.sum("value").alias("added"))
    both = sums.unionByName(sums.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "added"))
    floor = F.expr(f"case when v > 0 then 1 + {2 * UNIT} div total else 1 end")
    left, right = (groups.select("lang", F.col("source").alias(s), F.col("g").alias(x), floor.alias(f"{x}_floor"), F.col("v").alias(f"{x}_v")) for s, x in (("source", "g"), ("item", "h")))
    pairs = both.join(left, ["lang", "g"]).join(right, ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("g_v * (((g_floor - h_floor) * (g_floor - h_floor)) div (g_floor + h_floor)) + added").alias("value"))
    terms = tiles.where("part = 'term'").join(groups.select("lang", "source", "g"), ["lang", "g"]).select("lang", "source", "part", F.col("term").alias("item"), "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
