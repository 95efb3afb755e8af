"""Chat formatting in Spark expressions only.

A conversation becomes one string. Adjacent turns of one role share a block; control strings divide its turns:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

Inside roles and texts a backslash is written ``\\e`` and ``<|`` is written ``<\\p`` (in roles a newline is ``\\n`` besides), so no control
string can come from a text and the original turns can be read back. ``loss`` lists the character ranges of assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("<\\p"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(out, F.lit("\\p"), F.lit("|")), F.lit("\\e"), F.lit("\\"))


def running(lengths: str) -> Column:
    """The sum of all values before each of an array column, in chunks of the cube root of its size: n^(4/3) additions, and no array grows by appending."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + y)
    step = F.greatest(F.lit(1), F.floor(F.cbrt(F.size(lengths).cast("double"))).cast("int"))
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), step)).otherwise(F.array().cast("array<int>"))
    chunks = F.transform(starts, lambda i: F.struct(F.slice(lengths, i, step).alias("own"), total(F.slice(lengths, i, step)).alias("sum")))
    # each chunk with the sums of all chunks, of which it adds up those before it
    add = lambda all_: lambda c, k: F.struct(c["own"].alias("own"), F.aggregate(F.slice(all_, 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x["sum"]).alias("base"))
    based = F.element_at(F.transform(F.array(chunks), lambda all_: F.transform(all_, add(all_))), 1)  # a lambda's variable is computed once
    return F.flatten(F.transform(based, lambda c: F.transform(c["own"], lambda _, i: c["base"] + total(F.slice(c["own"], 1, i)))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted string, loss array<struct<start, length>>`` from ``turns(conv_id, turn, role, text)``.

    Turns are ordered by turn, ties by role and text, null turns first. Null roles and texts are empty. A null conv_id is a conversation
    of its own; an empty table gives no rows; repeated rows are repeated turns; other columns are ignored. A conversation is one string, of 2 GB at most; its work
    grows about as its turns and its characters do.
    """
    t = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # first turns of blocks: those whose role differs from the turn before
    at = F.sequence(F.lit(1), F.size("turns"))
    opens = F.filter(at, lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    blocks = sorted_turns.withColumn("opens", opens).withColumn(
        "blocks",
        F.transform("opens", lambda first, k: F.struct(
            F.element_at("turns", first)["role"].alias("role"),
            F.transform(F.slice("turns", first, F.coalesce(F.try_element_at("opens", k + 2), F.size("turns") + 1) - first), lambda x: escape(x["text"])).alias("texts"),
        )),
    )
    # pieces in order: what stands before a text, the text, whether it is learned
    pieces = F.flatten(F.transform("blocks", lambda b, k: F.transform(b["texts"], lambda x, i: F.struct(
        F.when(i > 0, F.lit(SEP)).otherwise(F.concat(F.when(k > 0, F.lit(END + "\n")).otherwise(F.lit("")), F.lit(START), escape(b["role"], role=True), F.lit("\n"))).alias("before"),
        x.alias("text"),
        (b["role"] == LEARNED).alias("learned"),
    ))))
    done = blocks.withColumn("pieces", pieces)
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(END + "\n"))
    done = done.withColumn("lengths", F.transform("pieces", lambda p: (F.length(p["before"]) + F.length(p["text"])).cast("bigint"))).withColumn("starts", running("lengths"))
    spans = F.transform(
        F.filter(F.arrays_zip("pieces", "starts"), lambda x: x["pieces"]["learned"]),
        lambda x: F.struct((x["starts"] + F.length(x["pieces"]["before"])).alias("start"), F.length(x["pieces"]["text"]).cast("bigint").alias("length")),
    )
    return done.select("conv_id", formatted.alias("formatted"), spans.alias("loss"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns array<struct<role, text>>, learned array<string>`` read back from ``format_conversations``: from the string and the ranges alone."""
    body = F.regexp_replace("formatted", r"^<\|im_start\|>", "")
    blocks = F.transform(F.split(body, r"<\|im_start\|>"), lambda b: F.struct(
        unescape(F.substring_index(b, "\n", 1), role=True).alias("role"),
        F.split(F.regexp_replace(F.regexp_replace(b, r"^[^\n]*\n", ""), r"<\|im_end\|>\n$", ""), r"<\|im_sep\|>").alias("texts"),
    ))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescape(x).alias("text")))))
    # a range is cut from a stretch of the string that holds as many ranges as there are stretches: a cut walks from its string's start
    step = F.greatest(F.lit(1), F.floor(F.sqrt(F.size("loss").cast("double"))).cast("int"))
    first = F.when(F.size("loss") > 0, F.sequence(F.lit(1), F.size("loss"), step)).otherwise(F.array().cast("array<int>"))
    stretches = F.transform(F.transform(first, lambda i: F.slice("loss", i, step)), lambda own: F.struct(
        own.alias("own"), F.element_at(own, 1)["start"].alias("from"),
        F.substring("formatted", F.element_at(own, 1)["start"].cast("int") + 1, (F.element_at(own, -1)["start"] + F.element_at(own, -1)["length"] - F.element_at(own, 1)["start"]).cast("int")).alias("text"),
    ))
    learned = F.flatten(F.transform(stretches, lambda x: F.transform(x["own"], lambda s: unescape(F.substring(x["text"], (s["start"] - x["from"]).cast("int") + 1, s["length"].cast("int"))))))
    return formatted.select("conv_id", turns.alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read back from the formatted strings."""
    back = parse_conversations(format_conversations(turns))
    text, loss = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), F.array_join("learned", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
