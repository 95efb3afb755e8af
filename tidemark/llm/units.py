"""Substring deduplication by hashing normalised units: lines, paragraphs, or lines cut further at sentence ends (the default).

1. Each batch of documents is cut into units, and each unit with a word gives a 128-bit digest of its normalised text. Within the
   batch only the earliest occurrence of a digest travels on; the others are repeats already (so a hot digest is at most a row a batch).
2. The earliest occurrences are ranked globally by digest; all but the first are repeats.
3. Repeats go back to their documents with their original character offsets. There, runs of repeats that follow one another are weighed: a
   run of enough words goes, a repeat on its own (a heading, a licence line, a short sentence) stays. A repeated line of that many words is such a run of its
   sentences, so cutting lines loses none of them, and a passage in the middle of longer lines is met, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, byte_slices, texts, utf8_parts

SPANS = "array<struct<start:int,end:int>>"
_ENDS = {"line": (10,), "sentence": (10, 33, 46, 63)}
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Units:
    """The units of a string column: document index, byte range (with the byte that ends it) and the normalised bytes of each.

    Lines end at a newline; sentences at a newline, ``.``, ``!`` or ``?``; paragraphs at a newline after a newline. Normal form: A-Z in
    lower case, runs of ``[\\x20\\x09-\\x0D]`` one space, none at the ends.
    """

    def __init__(self, column: pa.Array, unit: str):
        data, offsets = utf8_parts(column)
        self.n = len(offsets) - 1
        if unit == "paragraph":
            stop = np.flatnonzero((data == 10) & np.append(False, data[:-1] == 10)) if len(data) else np.zeros(0, np.int64)
        else:
            stop = np.flatnonzero(np.isin(data, np.array(_ENDS[unit], np.uint8)))
        edges = np.unique(np.concatenate([stop + 1, offsets]))
        self.start, self.end = edges[:-1], edges[1:]
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        space = _SPACE[data]
        if unit == "sentence":
            space = space | np.isin(data, np.array((33, 46, 63), np.uint8))
        apart = np.append(True, space)
        apart[self.start] = True
        word = np.flatnonzero(~space & apart[:-1])
        first, last = np.searchsorted(word, self.start), np.searchsorted(word, self.end)
        self.words = last - first
        # normalised bytes: solid ones, and one space before each word but the first of its unit
        lead = np.ones(len(word), bool)
        lead[first[self.words > 0]] = False
        keep = ~space
        width = keep.astype(np.int8)
        width[word[lead]] += 1
        upto = np.append(0, np.cumsum(width, dtype=np.int64))
        out = np.full(int(upto[-1]), 32, np.uint8)
        out[(upto[1:] - 1)[keep]] = _LOWER[data[keep]]
        self.normal = out.tobytes()
        self.normal_start, self.normal_end = upto[self.start], upto[self.end]
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        self.char_start = points[self.start] - points[offsets[self.doc]]
        self.char_end = points[self.end] - points[offsets[self.doc]]

    def digests(self, at: np.ndarray) -> np.ndarray:
        """Two 64-bit words of each unit's XXH3-128 digest."""
        f, raw = xxhash.xxh3_128_digest, self.normal
        found = b"".join([f(raw[a:b]) for a, b in zip(self.normal_start[at].tolist(), self.normal_end[at].tolist(), strict=True)])
        return np.frombuffer(found, "<i8").reshape(-1, 2)


def occurrences(docs: DataFrame, unit: str) -> DataFrame:
    """``doc_id, th, start, h1, h2, again``: every unit with a word; ``again`` if an earlier one lies in the same batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch, "text", 1 << 22):
                units = Units(batch.column("text").slice(lo, hi - lo), unit)
                at = np.flatnonzero(units.words > 0)
                h = units.digests(at)
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(units.doc[at]))
                th = np.asarray(batch.column("th").slice(lo, hi - lo))[units.doc[at]]
                no_id = np.asarray(ids.is_null())
                number = np.asarray(ids.fill_null(0))
                start = units.char_start[at]
                order = np.lexsort((start, th, number, no_id, h[:, 1], h[:, 0]))
                same = np.append(False, (h[order][1:] == h[order][:-1]).all(axis=1))
                group = np.cumsum(~same) - 1
                first = order[~same][group] if len(order) else order
                twin = (no_id[order] == no_id[first]) & (number[order] == number[first]) & (th[order] == th[first]) & (start[order] == start[first])
                again = np.zeros(len(at), bool)
                again[order] = ~twin
                yield pa.RecordBatch.from_arrays([ids, pa.array(th), pa.array(start.astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(again)], ["doc_id", "th", "start", "h1", "h2", "again"])

    return texts(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, start int, h1 long, h2 long, again boolean")


def runs_of_repeats(units: Units, repeated: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each run to remove: repeats that follow one another in a document, units without a word between them included."""
    at = np.flatnonzero(units.words > 0)
    hit = repeated[at]
    doc, words = units.doc[at], np.where(hit, units.words[at], 0)
    opens = hit & np.append(True, ~hit[:-1] | (doc[1:] != doc[:-1]))[: len(at)]
    first = np.flatnonzero(opens)
    last = np.flatnonzero(hit & np.append((~hit[1:]) | (doc[1:] != doc[:-1]), True)[: len(at)])
    upto = np.append(0, np.cumsum(words))
    enough = upto[last + 1] - upto[first] >= min_words
    first, last = first[enough], last[enough]
    return doc[first], units.char_start[at[first]], units.char_end[at[last]]


def repeated_units(docs: DataFrame, unit: str = "sentence", min_words: int = 25) -> DataFrame:
    """``doc_id, text, removed array<struct<start, end>>, kept``: documents without passages whose units earlier documents hold.

    Of all units of one normal form the one with the smallest (doc_id, text hash, start) stays for good, the others are repeats; a run of
    repeats with ``min_words`` words or more goes, together with the characters that end its units. ``removed`` holds the runs in code points of the
    original text. Null texts are empty and lose nothing; null doc_ids rank last; rows alike in doc_id and text are one document and share its result;
    very long texts are cut like any other; an empty table gives no rows. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "units")
    found = work.table(occurrences(docs, unit), "occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "start")
    earliest = found.where("not again").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")  # combined before the shuffle
    later = found.where("not again").withColumn("place", place).join(earliest, ["h1", "h2"]).where("place <> first")
    repeats = later.select("doc_id", "th", "start").unionByName(found.where("again").select("doc_id", "th", "start"))
    starts = repeats.groupBy(F.col("doc_id").alias("s_doc"), F.col("th").alias("s_th")).agg(F.collect_set("start").alias("starts"))  # of one document
    docs = texts(docs).withColumn("th", F.xxhash64("text"))
    told = docs.join(starts, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("th") == F.col("s_th")), "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch, "text", 1 << 22):
                piece = batch.slice(lo, hi - lo)
                column, told_starts = piece.column("text"), piece.column("starts")
                units = Units(column, unit)
                # a repeat is found by its document and start
                here = np.repeat(np.arange(hi - lo), np.asarray(told_starts.value_lengths().fill_null(0)))
                key = np.sort(here << 32 | np.asarray(told_starts.flatten()).astype(np.int64))
                own = units.doc << 32 | units.char_start
                hit = np.searchsorted(key, own)
                repeated = np.append(key, -1)[hit] == own
                doc, start, end = runs_of_repeats(units, repeated, min_words)
                kept, removed = column.to_pylist(), [None] * (hi - lo)
                for d in np.unique(doc).tolist():
                    a, b = np.searchsorted(doc, (d, d + 1))
                    removed[d] = [{"start": x, "end": y} for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                    edges = [0, *(x for r in removed[d] for x in (r["start"], r["end"])), None]
                    kept[d] = "".join(kept[d][x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), column, spans, pa.array(kept, pa.string())], ["doc_id", "text", "removed", "kept"])

    return told.mapInArrow(cut, f"doc_id long, text string, removed {SPANS}, kept string")
