"""Token-ID / binary output: concatenated id arrays whose document boundaries are Elias-Fano coded.

File format (a folder any Hadoop file system can hold, written and read by Spark only):

* ``blocks/`` (Parquet), one row a block of consecutive documents: ``part, block`` (order), ``base`` (ids of the part before
  this block), ``n_docs``, ``n_ids``, ``n_null`` (documents without an id, which come first), ``first_doc`` and ``doc_ids`` (the other
  ids less the first, Elias-Fano coded), ``bounds`` (Elias-Fano coded ends of its documents), ``width`` (2 or 4) and ``ids``
  (little-endian unsigned integers of that width, 2 where the vocabulary fits).
* ``manifest/`` (Parquet), one row a part: ``part, first_id`` (ids of all parts before it), ``n_ids, n_docs``.

Parts, blocks in a part and documents in a block ascend by doc_id, so ``first_id + base + boundary`` is a document's global start.
Blocks are bounded, so boundaries inside one need no 64-bit table however large the corpus is.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE, Workspace, byte_slices, partitions, small_batches, span_hashes, texts, trim, utf8_parts, words_at

BLOCK_IDS = 1 << 20
BLOCKS = "part int, block int, base long, n_docs int, n_ids long, n_null int, first_doc long, doc_ids binary, bounds binary, width int, ids binary"
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of n values up to u in about 2 + log2(u / n) bits a value, with select and rank.

    The low ``l`` bits of each value lie packed; the high parts are unary in a bit vector: value i sets bit (v_i >> l) + i.
    ``select`` needs only a 32-bit count of ones before every 512 bits, made when the structure is opened.
    """

    WORDS = 8

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.uint32)
        self._in_word = ones
        groups = np.add.reduceat(ones, np.arange(0, len(ones), self.WORDS)) if len(ones) else np.zeros(0, np.uint32)
        self._before = np.concatenate([[0], np.cumsum(groups)]).astype(np.uint32)

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        if len(v) > 1 and (v[1:] < v[:-1]).any():
            raise ValueError("Elias-Fano needs a non-decreasing sequence")
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
        if low_bits:
            bit = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            part = v & np.uint64((1 << low_bits) - 1)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (v >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros((int(ones[-1]) >> 6) + 1 if n else 0, np.uint64)
        np.bitwise_or.at(high, (ones >> np.uint64(6)).astype(np.int64), np.uint64(1) << (ones & np.uint64(63)))
        return cls(n, low_bits, low, high)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u4")
        return head.tobytes() + self.low.astype("<u8").tobytes() + self.high.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = (int(x) for x in np.frombuffer(data, "<u4", 4))
        return cls(n, low_bits, np.frombuffer(data, "<u8", a, 16), np.frombuffer(data, "<u8", b, 16 + 8 * a))

    def _low_parts(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        x = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > 64
        x[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return x & np.uint64((1 << self.low_bits) - 1)

    def select(self, i):
        """The i-th value (from 0), or those of an array of places: binary search of the directory, then at most 8 words of 64 bits each."""
        at = np.atleast_1d(np.asarray(i, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError(i)
        group = np.searchsorted(self._before, at, "right") - 1
        left, word = at - self._before[group], group * self.WORDS
        for _ in range(self.WORDS - 1):
            on = left >= self._in_word[np.minimum(word, len(self._in_word) - 1)]
            left = left - np.where(on, self._in_word[np.minimum(word, len(self._in_word) - 1)], 0)
            word = word + on
        x, bit = self.high[word].astype(np.uint64), np.zeros(len(at), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):  # the place of the one inside its word, by halves
            ones = np.bitwise_count((x >> bit) & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= ones
            left = left - np.where(on, ones, 0)
            bit = bit + np.where(on, np.uint64(half), np.uint64(0))
        high = (word.astype(np.uint64) << np.uint64(6)) + bit - at.astype(np.uint64)
        found = (high << np.uint64(self.low_bits)) | self._low_parts(at)
        return found if np.ndim(i) else int(found[0])

    def owner(self, position: int) -> int:
        """The document holding this id position: how many ends are at or before it."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.select(mid) <= position else (lo, mid)
        return lo


class Encoder:
    """Encodes texts with a ``tokenizers`` file, one token list a distinct piece.

    Byte-level BPE with the usual word pattern works on each pre-token alone. Text is cut (in numpy, on UTF-8) only where the
    pattern must end a pre-token whatever surrounds it: an ASCII letter before an ASCII non-letter, a sure non-space before a
    space or newline, and after a lone newline. The library encodes every distinct piece once and a bounded memo repeats it;
    pieces over ``LONG`` bytes are never memoised, and a memo is used only for the very bytes it was made from. Whole texts go to
    the library if they hold one of its added tokens (which it finds before it cuts), or with a tokenizer of another kind.
    """

    LONG, MEMO = 64, 2_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = sorted({t["content"] for t in spec.get("added_tokens") or () if t["content"]})
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["model"].get("dropout")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        newline = self._library(["\n"])[0] if self.by_piece else []
        self.newline = newline[0] if len(newline) == 1 else None
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.starts, self.lengths = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.texts, self.text_starts, self.text_sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _library(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for i in range(0, len(pieces), 512) for x in self.tokenizer.encode_batch_fast(pieces[i : i + 512], add_special_tokens=False)]

    def _pieces(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of many pieces, and how many each has.

        Pieces that begin and end with a sure non-space (after one space at most) and hold no newline go to the library joined
        by newlines: the pattern then gives each newline a token of its own, at which the ids are split again.
        """
        raw = b.tobytes()
        first = b[start]
        inner = start + (first == 32)
        solid = (b > 32) & (b < 127)
        head = solid[np.minimum(inner, len(b) - 1)] | (b[np.minimum(inner, len(b) - 1)] == 0xC3)
        tail = solid[end - 1] | ((b[end - 1] >= 128) & (b[np.maximum(end - 2, 0)] == 0xC3))
        lines = np.append(0, np.cumsum(b == 10))
        plain = (inner < end) & head & tail & (lines[end] == lines[start]) if self.newline is not None else np.zeros(len(start), bool)
        sizes = np.zeros(len(start), np.int64)
        found = []
        for lo in range(0, int(plain.sum()), 4096):
            at = np.flatnonzero(plain)[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join([raw[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]).decode()], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.append(np.flatnonzero(ids == self.newline), len(ids))
            if len(stops) != len(at):
                raise ValueError("the tokenizer joins pieces over a newline")
            sizes[at] = np.diff(np.append(-1, stops)) - 1
            found.append(ids[ids != self.newline])
        rest = np.flatnonzero(~plain)
        got = self._library([raw[s:e].decode() for s, e in zip(start[rest].tolist(), end[rest].tolist(), strict=True)])
        sizes[rest] = [len(x) for x in got]
        order = np.append(np.flatnonzero(plain), rest)
        flat = np.concatenate([*found, np.array([i for x in got for i in x], self.dtype)])
        have, want = np.cumsum(sizes[order]) - sizes[order], np.empty(len(start), np.int64)
        want[order] = have
        ends = np.cumsum(sizes)
        return flat[np.repeat(want - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes

    @staticmethod
    def cuts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted starts of the pieces of all texts (empty texts have none)."""
        if not len(b):
            return np.zeros(0, np.int64)
        letter = ((b | 32) >= 97) & ((b | 32) <= 122)
        solid = (b > 32) & (b < 127)
        solid[1:] |= (b[1:] >= 128) & (b[:-1] == 0xC3)
        blank = (b == 32) | (b == 10)
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = (letter[:-1] & ~letter[1:] & ((b[1:] < 127) & (b[1:] >= 32) | (b[1:] == 10))) | (solid[:-1] & blank[1:])
        if len(b) > 2:
            cut[2:-1] |= solid[:-2] & (b[1:-1] == 10) & (((b[2:] > 32) & (b[2:] < 127)) | (b[2:] == 0xC3))
        cut[offsets] = True
        return np.flatnonzero(cut[:-1])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, concatenated, and the number of ids of each text."""
        whole = np.full(len(column), not self.by_piece)
        for token in self.added:
            whole |= np.asarray(pc.match_substring(column, token))
        if not whole.any():
            return self._by_piece(column)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        each = dict(zip(np.flatnonzero(whole).tolist(), self._library(column.filter(pa.array(whole)).to_pylist()), strict=True))
        ids, n = self._by_piece(column.filter(pa.array(~whole))) if not whole.all() else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        size = np.zeros(len(column), np.int64)
        size[~whole] = n
        cuts, parts, at = np.append(0, np.cumsum(n)), [], 0
        for i in range(len(column)):
            if whole[i]:
                size[i] = len(each[i])
                parts.append(np.array(each[i], self.dtype))
            else:
                parts.append(ids[cuts[at] : cuts[at + 1]])
                at += 1
        return np.concatenate(parts), size

    def _by_piece(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        b, offsets = utf8_parts(column)
        start = self.cuts(b, offsets)
        end = np.append(start[1:], len(b))
        key = span_hashes(b, start, end)
        apart = end - start > self.LONG
        if len(self.keys) > self.MEMO:
            self._reset()
        codes, distinct = pd.factorize(key[~apart])
        slot = self._slots(distinct, b, start[~apart], end[~apart], codes)
        of = np.zeros(len(start), np.int64)
        of[~apart] = slot[codes] if len(codes) else 0
        same = np.flatnonzero(~apart)
        apart[same[~self._alike(b, start[same], end[same], of[same])]] = True  # another piece with its hash: encoded by itself
        flat, starts, lengths = self.flat, self.starts, self.lengths
        if apart.any():
            more, sizes = self._pieces(b, start[apart], end[apart])
            of[apart] = len(starts) + np.arange(len(sizes))
            starts, lengths, flat = np.append(starts, len(flat) + np.cumsum(sizes) - sizes), np.append(lengths, sizes), np.append(flat, more)
        n = lengths[of].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[of] - (ends - n), n) + np.arange(total)]
        upto = np.append(0, ends)[np.searchsorted(start, offsets)]
        return ids, np.diff(upto)

    def _alike(self, b: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether each piece has the very bytes its slot was made from, compared 8 at a time."""
        size, other = end - start, self.text_starts[slot]
        good = size == self.text_sizes[slot]
        at = np.flatnonzero(good)
        mine, theirs = words_at(b), words_at(self.texts)
        for k in range(0, self.LONG, 8):
            at = at[size[at] > k]
            if not len(at):
                break
            unlike = mine[start[at] + k] ^ theirs[other[at] + k]
            left = np.minimum(size[at] - k, 8).astype(np.uint64)
            bad = (unlike << (np.uint64(64) - np.uint64(8) * left)) != 0
            good[at[bad]] = False
        return good

    def _slots(self, distinct: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        slot = np.zeros(len(distinct), np.int64)
        slot[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            new = new[np.argsort(distinct[new])]
            more, sizes = self._pieces(b, start[first[new]], end[first[new]])
            slot[new] = len(self.starts) + np.arange(len(new))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
            self.lengths, self.flat = np.append(self.lengths, sizes.astype(np.int32)), np.append(self.flat, more)
            lo, size = start[first[new]], end[first[new]] - start[first[new]]
            place = np.cumsum(size) - size
            self.text_starts, self.text_sizes = np.append(self.text_starts, len(self.texts) + place), np.append(self.text_sizes, size)
            self.texts = np.append(self.texts, b[np.repeat(lo - place, size) + np.arange(int(size.sum()))])
            self.keys, self.slots = np.insert(self.keys, at[new], distinct[new]), np.insert(self.slots, at[new], slot[new])
        return slot


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode_part(tokenizer: str, end_id: int, block_ids: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("n_null", pa.int32()), ("first_doc", pa.int64()), ("doc_ids", pa.binary()), ("bounds", pa.binary()), ("width", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        block, base = 0, 0
        held_ids, held_lengths, held_docs, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, base, held
            ids, lengths = np.concatenate(held_ids), np.concatenate(held_lengths)
            docs = pa.concat_arrays(held_docs)
            known = np.asarray(docs.drop_null())
            first = int(known[0]) if len(known) else 0
            named = EliasFano.encode(known.view(np.uint64) - np.uint64(first & (1 << 64) - 1)).to_bytes()
            row = [[part], [block], [base], [len(lengths)], [len(ids)], [docs.null_count], [first], [named], [EliasFano.encode(np.cumsum(lengths)).to_bytes()], [enc.width], [ids.tobytes()]]
            block, base, held = block + 1, base + len(ids), 0
            for x in (held_ids, held_lengths, held_docs):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for lo, hi in byte_slices(batch, "text", SLICE):
                ids, n = enc(batch.column("text").slice(lo, hi - lo))
                ids = np.insert(ids, np.cumsum(n), end_id).astype(enc.dtype)
                ends = np.cumsum(n + 1)
                at = 0
                while at < len(n):  # as many whole documents as fit the block, one at least
                    before = int(ends[at - 1]) if at else 0
                    to = int(np.searchsorted(ends, before + max(0, block_ids - held), "right"))
                    if to <= at:
                        if held:
                            yield flush()
                            continue
                        to = at + 1
                    held_ids.append(ids[before : int(ends[to - 1])])
                    held_lengths.append(n[at:to] + 1)
                    held_docs.append(batch.column("doc_id").slice(lo + at, to - at))
                    held += int(ends[to - 1]) - before
                    at = to
        if held:
            yield flush()
        trim()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, n_parts: int | None = None, block_ids: int = BLOCK_IDS) -> str:
    """Encodes ``docs(doc_id, text)`` and writes the format above to ``path``.

    Null texts are empty (only the end id); null doc_ids come first; rows with one doc_id are ordered by text. An empty table
    gives empty blocks and manifest. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    n = n_parts or partitions(spark)
    ordered = texts(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    with small_batches(spark):
        ordered.mapInArrow(_encode_part(tokenizer, end_id, block_ids), BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"))
    # one row a part, at most n of them: small enough for a single running sum
    running = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.select("part", F.coalesce(running, F.lit(0).cast("long")).alias("first_id"), "n_ids", "n_docs").write.mode("overwrite").parquet(f"{path}/manifest")
    return path


def _blocks(spark: SparkSession, path: str, column: str) -> DataFrame:
    manifest = spark.read.schema("part int, first_id long").parquet(f"{path}/manifest")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks.join(F.broadcast(manifest), "part").select(*column.split(","), (F.col("first_id") + F.col("base")).alias("first"))


READ = "n_docs,n_null,first_doc,doc_ids,bounds,width,ids"
CHUNK = 4096


def _documents(batch: pa.RecordBatch):
    """(doc_ids, their starts, ids, where each document's begin and end) of up to ``CHUNK`` documents at a time, by select on the two structures."""
    for row in batch.to_pylist():
        ids = np.frombuffer(row["ids"], f"<u{row['width']}")
        bounds, named, nulls = EliasFano.from_bytes(row["bounds"]), EliasFano.from_bytes(row["doc_ids"]), row["n_null"]
        for lo in range(0, row["n_docs"], CHUNK):
            hi = min(lo + CHUNK, row["n_docs"])
            at = np.append(bounds.select(lo - 1) if lo else 0, bounds.select(np.arange(lo, hi)).astype(np.int64))
            number = (named.select(np.arange(max(lo, nulls), max(hi, nulls)) - nulls) + np.uint64(row["first_doc"] & (1 << 64) - 1)).view(np.int64)
            docs = pa.concat_arrays([pa.nulls(min(hi, max(lo, nulls)) - lo, pa.int64()), pa.array(number)])
            yield docs, row["first"] + at[:-1], ids, at


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids array<long>`` of every document, from the written files. The manifest has a row a part and is broadcast."""

    def run(batches):
        for batch in batches:
            for docs, start, ids, at in _documents(batch):
                own = ids[at[0] : at[-1]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([docs, pa.array(start, pa.int64()), pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(own))], ["doc_id", "start", "ids"])

    return _blocks(spark, path, READ).mapInArrow(run, "doc_id long, start long, ids array<bigint>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files at ``path``."""

    def run(batches):
        for batch in batches:
            for docs, start, ids, at in _documents(batch):
                wide = ids[at[0] : at[-1]].astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs, pa.array(start, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _blocks(spark, path, READ).mapInArrow(run, DIGESTS)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes ``docs`` in the file format under the shared work folder and returns the digests read back from it."""
    work = Workspace(docs.sparkSession, "token-ids")
    return token_digests(docs.sparkSession, write_tokens(docs, work.path, tokenizer, end_id))
