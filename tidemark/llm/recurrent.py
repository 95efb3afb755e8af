"""Log-probabilities of whole documents under a gated recurrent model (``gru``) that is trained on the corpus itself.

1. Tasks cut the documents into blocks: a row holds its documents' lengths, its distinct words and a code a token. Words with their counts in training
   documents go to a shuffle, are summed, and the sums come back to the blocks that asked.
2. The most frequent words (a documented bound) are outcomes of the network; all others fall into tail classes by their last byte, and
   their shares within a class are counted, not learnt. Blocks are rewritten as these outcomes.
3. Training goes over every training document once, in rounds: each task trains from the round's parameters on its blocks, and the parameters of
   all tasks are averaged by tokens. They have one bounded size, whatever the corpus.
4. Every document is scored by the last parameters, its state carried from window to window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gru
from .common import Workspace, partitions, trim, utf8_parts
from .divergence import pieces

BLOCK_BYTES = 12 << 20
PIECE = 1 << 22  # bytes of a text cut into words at once
HEAD = 4096  # words that the network tells apart
HEAD_BYTES = 64  # longer words are told by their counts only
CLASSES = 64  # of the head; and
TAIL = 32  # of all other words, by five bits of the last byte
ROUNDS = 4
CHUNK = 1 << 14  # parameters in a row
DISCOUNT = 0.5  # taken from each tail word's count for words not seen in training
FOLDS, HELD_OUT = 5, 1
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
BLOCKS = "block long, round int, doc_ids array<long>, lengths array<long>, words array<binary>, trained array<long>, codes binary"
CODED = "block long, round int, doc_ids array<long>, lengths array<long>, known array<long>, base array<double>, tail array<double>, ids binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_ids: list[int | None]) -> np.ndarray:
    """Whether crc32 of the id as text leaves ``HELD_OUT`` of ``FOLDS``; a null id counts as the empty text, which trains."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in doc_ids], bool)


class _Block:
    def __init__(self):
        self.ids: list[int | None] = []
        self.coded: list[pa.DictionaryArray] = []
        self.lengths: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_ids: list[int | None], texts: pa.Array, size: int) -> None:
        """A text above ``PIECE`` that comes alone is worked on in pieces."""
        long = len(doc_ids) == 1 and size > PIECE
        parts = (pa.array([p], pa.large_binary()).view(pa.large_string()) for p in pieces(utf8_parts(texts)[0].tobytes().translate(WORD_BYTES), PIECE)) if long else [texts]
        found = [self._words(p) for p in parts]
        self.ids += doc_ids
        self.lengths.append(np.sum(found, axis=0) + 1)
        self.size += size

    def _words(self, texts: pa.Array) -> np.ndarray:
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # empty before a space that begins a text, and after one that ends it
        ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        self.coded.append(parts.flatten().dictionary_encode())
        real = pc.greater(pc.binary_length(self.coded[-1].dictionary), 0).to_numpy(zero_copy_only=False)
        return np.diff(np.append(0, np.cumsum(real[self.coded[-1].indices.to_numpy()]))[ends])

    def tokens(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words (the first is none: the end of a document), a code a token, tokens of each document."""
        coded = pa.chunked_array([c.cast(pa.dictionary(pa.int32(), pa.large_binary())) for c in self.coded]).unify_dictionaries().chunks
        self.coded, words, lengths = [], coded[0].dictionary, np.concatenate(self.lengths)
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        code = (np.cumsum(real) * real).astype(np.uint32)
        out = np.zeros(int(lengths.sum()), np.uint32)
        word = np.ones(len(out), bool)
        word[np.cumsum(lengths) - 1] = False
        own = [code[c.indices.to_numpy()] for c in coded]
        out[word] = np.concatenate([c[c > 0] for c in own])
        return pa.concat_arrays([pa.array([b""], pa.large_binary()), words.filter(pa.array(real))]).cast(pa.binary()), out, lengths

    def row(self, block: int, rounds: int) -> pa.RecordBatch:
        words, codes, lengths = self.tokens()
        trained = np.bincount(codes[np.repeat(~held_out(self.ids), lengths)], minlength=len(words))
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([block % rounds], pa.int32()), one(self.ids, pa.int64()), one(lengths, pa.int64()), one(words, pa.binary()), one(trained, pa.int64()), pa.array([pa.compress(codes.astype("<u4").tobytes(), codec="zstd", asbytes=True)], pa.binary())],
            ["block", "round", "doc_ids", "lengths", "words", "trained", "codes"],
        )


def _blocks(limit: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, block = part << 32 | part % rounds, _Block()  # first blocks of tasks are spread over the rounds, too
        for batch in batches:
            text, doc_ids, lo = batch.column("text"), batch.column("doc_id").to_pylist(), 0
            upto = utf8_parts(text)[1] + 64 * np.arange(batch.num_rows + 1)
            while lo < batch.num_rows:
                hi = int(np.searchsorted(upto, upto[lo] + limit - block.size + 64, "right")) - 1  # the last row's 64 do not count
                if hi <= lo and block.ids:
                    yield block.row(name, rounds)
                    name, block = name + 1, _Block()
                    continue
                hi = min(max(hi, lo + 1), batch.num_rows)
                block.add(doc_ids[lo:hi], text.slice(lo, hi - lo), int(upto[hi] - upto[lo]))
                lo = hi
        if block.ids:
            yield block.row(name, rounds)
        trim()

    return run


class Shares:
    """What a task needs to know of the counts: the head words, and sums of the tail classes. Bounded by ``HEAD`` words."""

    def __init__(self, head: list[tuple[bytes, int]], tail: dict[int, tuple[int, int]], tokens: int, words: int):
        """``tail``: tokens and words of each class but for head words; ``tokens`` and ``words`` of all training documents."""
        self.head = {w: k for k, (w, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], np.float64)
        self.tail_tokens, self.tail_words = (np.array([tail.get(k, (0, 0))[x] for k in range(TAIL)], np.float64) for x in (0, 1))
        self.tokens, self.words = tokens, words

    def layout(self) -> gru.Layout:
        return gru.Layout(self.counts, self.tail_tokens, CLASSES)

    def outcomes(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its outcome, log10 of its share within its tail class (0 for head words), and log10 of its smoothed share of all tokens."""
        n = len(self.head)
        data, ends = utf8_parts(words)
        last = np.append(data, np.uint8(0))[ends[1:] - 1].astype(np.int64) * (np.diff(ends) > 0)  # byte, 0 if there is none
        ids = pc.index_in(words, value_set=pa.array(list(self.head), words.type)).fill_null(-1).to_numpy().astype(np.int64)
        ids = np.where(ids < 0, n + last % TAIL, ids)
        kind = np.maximum(ids - n, 0)
        total, distinct = self.tail_tokens[kind], self.tail_words[kind]
        share = np.where(counts > 0, counts - DISCOUNT, DISCOUNT * distinct)
        share = np.where((ids < n) | (total == 0), 1, share / np.maximum(total, 1))
        base = (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))
        return ids, np.log10(share), np.log10(base)


def _code(shares):
    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        words = blocks.column("words")[0].values
        counts = np.zeros(len(words), np.int64)
        counts[answers.column("i").to_numpy()] = answers.column("c").to_numpy()
        ids, tail, base = shares.value.outcomes(words, counts)
        lengths = np.array(blocks.column("lengths")[0].as_py(), np.int64)
        codes = np.frombuffer(pa.decompress(blocks.column("codes")[0].as_py(), int(lengths.sum()) * 4, codec="zstd", asbytes=True), "<u4")
        first = np.cumsum(lengths) - lengths
        one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
        sums = lambda x: np.add.reduceat(x[codes], first)
        return pa.table([
            blocks.column("block"), blocks.column("round"), blocks.column("doc_ids"), blocks.column("lengths"), one(sums((counts > 0).astype(np.int64)), pa.int64()),
            one(sums(base), pa.float64()), one(sums(tail), pa.float64()), pa.array([ids.astype("<u2")[codes].tobytes()], pa.binary()),
        ], ["block", "round", "doc_ids", "lengths", "known", "base", "tail", "ids"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i] for c in batch.schema.names}
            r |= {c: np.asarray(r[c].values) for c in ("lengths", "known", "base", "tail") if c in r}
            r["doc_ids"], r["ids"] = r["doc_ids"].as_py(), np.frombuffer(r["ids"].as_py(), "<u2")
            r["starts"] = np.cumsum(r["lengths"]) - r["lengths"]
            yield r


PARTS = "chunk int, task long, tokens long, weights binary"


def _train(shares, params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, first = None, 0
        for r in _rows(batches):
            if trainer is None:
                trainer, first = gru.Trainer(shares.value.layout(), params.value), r["block"].as_py()
            learn = ~held_out(r["doc_ids"])
            trainer.fit(r["ids"], r["starts"][learn], r["lengths"][learn])
        if trainer is not None and trainer.tokens:
            flat = np.concatenate([trainer.net.p[k].ravel() for k in gru.NAMES])
            for k, lo in enumerate(range(0, len(flat), CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([first], pa.int64()), pa.array([trainer.tokens], pa.int64()), pa.array([flat[lo : lo + CHUNK].astype("<f4").tobytes()], pa.binary())], ["chunk", "task", "tokens", "weights"])
        trim()

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means by tokens, one chunk after another; rows come sorted by (chunk, task) and are added as they come."""
    now, total, tokens = None, None, 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([0], pa.int64()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary())], ["chunk", "task", "tokens", "weights"])

    for batch in batches:
        for r in batch.to_pylist():
            if r["chunk"] != now:
                if now is not None:
                    yield told()
                now, total, tokens = r["chunk"], 0.0, 0
            total = total + np.frombuffer(r["weights"], "<f4").astype(np.float64) * r["tokens"]
            tokens += r["tokens"]
    if now is not None:
        yield told()


def _score(shares, params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = gru.Network(shares.value.layout(), params.value)
        for r in _rows(batches):
            score = gru.log_likelihood(net, r["ids"], r["starts"], r["lengths"]) / np.log(10) + r["tail"]
            n = len(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(held_out(r["doc_ids"])), pa.array(r["lengths"]), pa.array(r["known"]), pa.array(np.full(n, shares.value.tokens, np.int64)), pa.array(r["base"]), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
        trim()

    return run


def score_documents(docs: DataFrame, rounds: int = ROUNDS, head: int = HEAD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``.

    Tokens are the words of a text (A-Z in lower case) and one end. ``base_score`` is log10 of the smoothed shares of a document's tokens, ``score`` log10
    of its probability under the network, which learns from all documents whose crc32(doc_id) mod 5 is not 1. Outcomes are the words of the training documents, and for each of
    the ``TAIL`` tail classes one outcome for all its unseen words; their probabilities add up to 1 after any beginning.

    Null texts are empty (one end); null ids train; repeated rows are rows of their own with one score; several texts of one id are documents of their own; very long texts are a block
    of their own, trained on in segments, scored as a whole; with nothing to train on all words are unseen; an empty table gives no rows; other columns are ignored.
    Runs agree up to the rounding of sums. ``head`` bounds what is broadcast: its words, and about 60 numbers a word.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "recurrent")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = work.table(plain.mapInArrow(_blocks(block_bytes, rounds), BLOCKS), "blocks", wide=True)
    asked = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("i", "w")).select(F.col("block").alias("of"), "i", F.col("w.words").alias("word"), F.col("w.trained").alias("n"))
    # one shuffle and one sort: a word's sum goes to each of its rows, a row a block at most, and the word itself stays in the first block's
    own = Window.partitionBy("word")
    summed = asked.select("of", "i", "word", F.sum("n").over(own).alias("c"), F.min("of").over(own).alias("first"))
    summed = work.table(summed.select("of", "i", F.expr("if(of = first, word, null)").alias("word"), "c"), "summed")
    counts = summed.where("word is not null and c > 0").select("word", "c")
    by_byte = {bytes(r["b"]): (r["c"], r["n"]) for r in counts.groupBy(F.substring("word", -1, 1).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}  # 257 rows at most
    top = counts.where((F.length("word") <= HEAD_BYTES) & (F.length("word") > 0)).orderBy(F.desc("c"), "word").limit(head - 1).collect()  # bounded by head
    own = sorted([*((bytes(r["word"]), r["c"]) for r in top), *((b"", c) for b, (c, _) in by_byte.items() if not b)], key=lambda x: (-x[1], x[0]))
    tail: dict[int, tuple[int, int]] = {}
    for b, (c, n) in by_byte.items():
        if b:
            mine = [x for w, x in own if w[-1:] == b]
            old = tail.get(b[0] % TAIL, (0, 0))
            tail[b[0] % TAIL] = (old[0] + c - sum(mine), old[1] + n - len(mine))
    shares_ = Shares(own, tail, sum(c for c, _ in by_byte.values()), sum(n for _, n in by_byte.values()))
    shares = spark.sparkContext.broadcast(shares_)
    coded = blocks.drop("trained").groupBy("block").cogroup(summed.select("of", "i", "c").groupBy("of")).applyInArrow(_code(shares), CODED)
    coded = work.table(coded, "coded", partition_by=["round"], wide=True)
    now = gru.fresh(shares_.layout())
    for k in range(rounds):
        params = spark.sparkContext.broadcast(now)
        trained = coded.where(F.col("round") == k).select("block", "doc_ids", "lengths", "ids").mapInArrow(_train(shares, params), PARTS)
        mean = work.table(trained.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "task").mapInArrow(_average, PARTS), f"round-{k}")
        flat = [np.frombuffer(r["weights"], "<f4") for r in mean.orderBy("chunk").collect()]  # the parameters once: bounded by head
        if flat:
            ends = np.cumsum([now[x].size for x in gru.NAMES])
            now = {x: part.reshape(now[x].shape).copy() for x, part in zip(gru.NAMES, np.split(np.concatenate(flat), ends[:-1]), strict=True)}
    params = spark.sparkContext.broadcast(now)
    return coded.mapInArrow(_score(shares, params), SCORES)
