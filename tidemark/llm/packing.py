"""Harmonic packing of token sequences: pieces are cut to the reciprocals of the capacity and each class is filled by count.

A document of n tokens gives full sequences of ``capacity`` tokens, then pieces of the largest size floor(capacity / k)
that still fits, until at most ``SHORT`` tokens are left; these form a last piece whose class is floor(capacity / length).
A bin of class k holds k pieces, so which bin a piece belongs to follows from its number within its class alone. Tasks
number their own pieces; adding the counts of earlier tasks makes the numbers global, so only the last bin of a class
can be short of pieces. The pieces of those last bins (fewer than k for each of about 130 classes) are strung together
and cut anew; the tail of that string is cut to powers of two, so nothing is padded there either.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import remembered, stored, text_of

CAPACITY, SHORT = 4096, 64
_PIECES = "doc_id long, start long, length long, doc_tokens long, class int, nth long, part int, ids binary"


#: Texts of these characters only have one composed form, and lower case and word breaks in them are the tokenizer's.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]*")
#: Runs of punctuation, but for those that touch an apostrophe (a contraction may begin there) or an underscore.
_POINTS = re.compile(r"(?<![^\w\s])(?<!_)[^\w\s'_]++(?!['_])")


class WordIds(dict):
    """Token ids of the runs between white space, as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its runs in order. It also
    lowers case and parts letters from punctuation; doing so before the look-up makes most runs known. Kept runs are
    dropped when they become many, which only costs time.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer, self.most = Tokenizer.from_file(path), most

    def __missing__(self, run: str) -> bytes:
        if len(self) > self.most:
            self.clear()
            self[""] = b""
        ids = array("I", self.tokenizer.encode(run, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        self[run] = out = ids.tobytes()
        return out

    def of(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:  # a special token keeps its case
            text = _POINTS.sub(r" \g<0> ", text.lower())
        runs = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join([self[run] for run in runs])


def word_ids(path: str) -> WordIds:
    """The worker's own; it lives until the worker serves another operator."""
    return remembered(f"word ids {path}", lambda: WordIds(path))


def cut_sizes(tokens: int, capacity: int = CAPACITY, short: int = SHORT) -> list[tuple[int, int]]:
    """(length, class) of each piece of a document, in order."""
    cuts = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest > short:
        k = -(-capacity // (rest + 1))  # smallest k whose share of the capacity may fit
        while capacity // k > rest:
            k += 1
        cuts.append((capacity // k, k))
        rest -= capacity // k
    if rest:
        cuts.append((rest, capacity // rest))
    return cuts


def _tokenize(path: str, end_id: int, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = word_ids(path), TaskContext.get().partitionId(), {}
        end = end_id.to_bytes(4, "little")
        names = [f.split()[0] for f in _PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, held = [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                ids, start = words.of(text.as_py()) + end, 0
                total, doc_id = len(ids) // 4, doc_id.as_py()
                for length, k in cut_sizes(total, capacity):
                    nth = seen.get(k, 0)
                    seen[k] = nth + 1
                    rows.append((doc_id, start, length, total, k, nth, part, ids[4 * start: 4 * (start + length)]))
                    start += length
                held += len(ids)
                if held > 8_000_000:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit token ids; each text's ids are followed by ``end_id``. ``offset`` is the
    piece's place in its sequence, gapless from 0. Null and empty texts have the end id alone; repeated rows are packed
    each; a null doc_id stays null; an empty table gives no pieces; other columns are left out. A long text is
    tokenized whole in the task that reads it.
    """
    pieces = stored(docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(_tokenize(tokenizer, end_id, capacity), _PIECES), "pieces")
    counts = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("class"))})
    # a last bin that is full stays; one that is short is taken apart
    counts = stored(counts.select("class", "part", "before", (F.col("all") - F.col("all") % F.col("class")).alias("full")), "class-counts")
    placed = pieces.join(counts, ["class", "part"]).withColumn("number", F.col("before") + F.col("nth"))
    kept = ["doc_id", "start", "length", "ids", "doc_tokens"]

    whole = placed.filter(F.col("number") < F.col("full"))
    slot = F.floor(F.col("number") / F.col("class")).cast("long")
    # all pieces of a class have one length, so a piece's offset follows from its place in the bin
    whole = whole.select(*kept, (slot * 8192 + F.col("class")).alias("sequence_id"), ((F.col("number") % F.col("class")) * F.col("length")).cast("long").alias("offset"))

    string = Window.orderBy("class", "number")
    rest = placed.filter(F.col("number") >= F.col("full")).withColumn("from", F.sum("length").over(string) - F.col("length"))
    rest = rest.withColumn("all", F.sum("length").over(Window.partitionBy()))
    tail = F.col("all") % capacity
    ends = F.expr(f"filter(transform(sequence(0, {capacity.bit_length() - 2}), b -> {capacity.bit_length() - 2} - b), b -> (shiftright(all % {capacity}, b) & 1) = 1)")
    # cuts of the tail: after each of its powers of two, largest first
    tail_cuts = F.transform(ends, lambda b: (F.col("all") - tail) + tail - tail % F.pow(F.lit(2), b).cast("long"))
    first, last = F.col("from"), F.col("from") + F.col("length")
    whole_cuts = F.transform(F.sequence(F.floor(first / capacity), F.floor(last / capacity)), lambda i: i * capacity)
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(first, last), F.filter(F.concat(whole_cuts, tail_cuts), lambda c: (c > first) & (c < last)))))
    rest = rest.withColumn("cuts", cuts).withColumn("tail_cuts", F.concat(F.array(F.col("all") - tail), tail_cuts))
    rest = rest.select("*", F.posexplode(F.slice("cuts", F.lit(1), F.size("cuts") - 1)).alias("i", "at"))
    size = F.element_at("cuts", F.col("i") + 2) - F.col("at")
    skip = F.col("at") - F.col("from")
    # a sequence is named by where it begins in the string
    begins = F.when(F.col("at") < F.col("all") - tail, F.col("at") - F.col("at") % capacity).otherwise(
        F.array_max(F.filter("tail_cuts", lambda c: c <= F.col("at"))))
    rest = rest.select(
        "doc_id", (F.col("start") + skip).alias("start"), size.alias("length"),
        F.substring("ids", (skip * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"), "doc_tokens",
        (-1 - begins).alias("sequence_id"), (F.col("at") - begins).alias("offset"))
    return whole.unionByName(rest)
