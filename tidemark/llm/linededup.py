"""Line dedup by content-defined chunks: runs of lines that repeat anywhere are removed but for their first place.

A rolling hash over the hashes of neighbouring lines cuts a text into chunks of about three lines. Where it cuts depends
on the lines around the cut alone, so text put in elsewhere moves no other cut. A line of fifty words or more is a chunk
of its own. Chunks of two or more lines, and such long lines, are grouped over all texts by their bytes.

The ends of a repeated passage stick to chunks that hold other lines as well, and a short passage may lie between two
cuts. So what the first round leaves is cut again at every line: the pairs of neighbouring lines that are still there,
and those across the end of a chunk that went, are grouped the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_of, with_rows

#: One in so many places between lines is a cut, words from which a line stands alone, and words of the shortest pair of lines.
SPACING, LONG_WORDS, PAIR_WORDS = 3, 50, 10
_MARK, _CUT, _BLANK = "\x01a", "\x01b", " \t\n\x0b\x0c\r"
#: A line's name inside its text: its chunk's place times this, plus its number there.
_PLACE = 1 << 32


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; joined by line feeds they are the text. A mark inside the text is escaped."""
    lines = F.split(F.replace(text, F.lit("\x01"), F.lit(_MARK)), "\n")
    facts = F.transform(lines, lambda line: F.struct(
        line.alias("line"), F.xxhash64(line).alias("hash"),
        _long(line).alias("long")))
    none = F.struct(F.lit("").alias("line"), F.lit(0).cast("long").alias("hash"), F.lit(False).alias("long"))
    pairs = F.zip_with(F.concat(F.array(none), facts), facts, lambda before, own: F.struct(before.alias("before"), own.alias("own")))
    rolled = lambda p: F.shiftleft(p["before"]["hash"], 1).bitwiseXOR(p["own"]["hash"])
    cut = lambda p: (F.pmod(rolled(p), F.lit(SPACING)) == 0) | p["own"]["long"] | p["before"]["long"]
    # the longer side of the pairing ends in a pair without a line of its own
    marked = F.transform(F.filter(pairs, lambda p: p["own"].isNotNull()), lambda p, i: F.when(cut(p) & (i > 0), F.concat(F.lit(_CUT), p["own"]["line"])).otherwise(p["own"]["line"]))
    return F.split(F.array_join(marked, "\n"), f"\n{_CUT}")


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit(_MARK), F.lit("\x01"))


def _pairs(lines: Column, name) -> Column:
    """``name(a, b)`` for all neighbours a, b among ``lines``."""
    both = F.zip_with(lines, F.slice(lines, F.lit(2), F.size(lines)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(F.filter(both, lambda p: p["b"].isNotNull()), lambda p: name(p["a"], p["b"]))


def _both(a: Column, b: Column) -> Column:
    """Two lines as one text; null if one of them is blank."""
    return F.when(~_blank(a) & ~_blank(b), F.concat(a, F.lit("\n"), b))


def _numbered(chunks: Column) -> Column:
    """The lines of a text's chunks as (id, line)."""
    own = lambda c, p: F.transform(F.split(c, "\n"), lambda line, i: F.struct((p.cast("long") * _PLACE + i).alias("id"), line.alias("line")))
    return F.flatten(F.transform(chunks, own))


def remove_repeated_chunks(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, text, removed_chunks, removed_lines, removed_chars``; ``text`` is what stays.

    Of equal chunks, and of equal pairs of neighbouring lines with ten words or more, the one in the smallest doc_id
    (null last), then the first stored row, then the first in the text stays; all others go, within one text too. The
    first place of a line always stays. Blank chunks, pairs with a blank line, and lines under fifty words that repeat
    without a neighbour always stay. Null text is empty and stays so; rows that repeat lose all their repeated lines
    to the first; an empty table gives no rows; other columns are left out. ``removed_chunks`` counts the chunks that
    lost a line, ``removed_chars`` what the text is shorter by.

    Chunks and pairs meet by two hashes, which travel without their texts. The texts of all that met are then compared
    as bytes, and the run stops if two of them share both hashes and differ.
    """
    base = with_rows(docs).select("doc_id", "_file", "_at", text_of().alias("text"))
    follows = lambda c: F.concat(F.slice(c, F.lit(2), F.size(c)), F.array(F.lit(None).cast("string")))
    pieces = base.select("doc_id", "_file", "_at", chunks_of(F.col("text")).alias("chunks")).select(
        "doc_id", "_file", "_at", F.posexplode(F.zip_with("chunks", follows(F.col("chunks")), lambda c, n: F.struct(
            c.alias("chunk"), F.concat_ws("\n", c, F.substring_index(n, "\n", 1)).alias("run")))).alias("place", "piece"))
    pieces = pieces.select("doc_id", "_file", "_at", "place", "piece.chunk", F.split("piece.run", "\n").alias("run"))
    lines = F.octet_length("chunk") - F.octet_length(F.replace("chunk", F.lit("\n"), F.lit(""))) + 1
    placed = pieces.select(
        "doc_id", "_file", "_at", "place", lines.alias("lines"), *_hashes(F.col("chunk")),
        (((lines > 1) | _long(F.col("chunk"))) & ~_blank(F.col("chunk"))).alias("whole"),
        F.transform(_pairs(F.col("run"), _both), lambda both: F.when(_spaced(both, PAIR_WORDS - 2), F.struct(*_hashes(both)))).alias("pairs"))
    placed = stored(placed, "chunks", "zstd")

    chunks = placed.filter("whole")
    met = chunks.join(_repeated(chunks, "place").hint("merge"), (F.col("h") == F.col("rh")) & (F.col("check") == F.col("rc")), "left")
    fate = ["doc_id", "_file", "_at", "place", "lines", "pairs"]
    met = met.select(*fate, F.col("first").isNotNull().alias("met"), F.coalesce(~_is(F.col("first"), "place"), F.lit(False)).alias("gone"))
    left = placed.filter("NOT whole").select(*fate, F.lit(False).alias("met"), F.lit(False).alias("gone"))
    walked = stored(met.unionByName(left), "first-round", "zstd")

    # of a chunk that went only its last line meets a neighbour that may have stayed
    pairs = walked.select("doc_id", "_file", "_at", "place", "lines", "gone", F.posexplode("pairs").alias("i", "pair"))
    pairs = pairs.filter(F.col("pair").isNotNull() & (~F.col("gone") | (F.col("i") == F.col("lines") - 1)))
    other = F.when(F.col("i") == F.col("lines") - 1, (F.col("place").cast("long") + 1) * _PLACE).otherwise(F.col("place").cast("long") * _PLACE + F.col("i") + 1)
    pairs = pairs.select("doc_id", "_file", "_at", (F.col("place").cast("long") * _PLACE + F.col("i")).alias("id"), other.alias("other"), "pair.h", "pair.check")
    twice = pairs.join(_repeated(pairs, "id").hint("merge"), (F.col("h") == F.col("rh")) & (F.col("check") == F.col("rc")))

    none = F.lit(None).cast("long")
    facts = walked.filter("met").select("_file", "_at", F.col("place").alias("met"), F.when(F.col("gone"), F.col("place")).alias("gone"), none.alias("pair"), none.alias("a"), none.alias("b"))
    lost = ~_is(F.col("first"), "id")
    facts = facts.unionByName(twice.select("_file", "_at", none.cast("int").alias("met"), none.cast("int").alias("gone"), F.col("id").alias("pair"),
                                           F.when(lost, F.col("id")).alias("a"), F.when(lost, F.col("other")).alias("b")))
    marks = facts.groupBy(F.col("_file").alias("m_file"), F.col("_at").alias("m_at")).agg(
        *[F.collect_list(c).alias(c) for c in ("met", "gone", "pair")], F.array_union(F.collect_list("a"), F.collect_list("b")).alias("lost"))
    marks = stored(marks, "marks", "zstd")

    out = base.join(marks.hint("merge"), (F.col("_file") == F.col("m_file")) & (F.col("_at") == F.col("m_at")), "left")
    # a column that several others read is worked out once, and only where something met
    found = F.col("met").isNotNull()
    out = out.withColumn("chunks", F.when(found, chunks_of(F.col("text"))))
    out = out.withColumn("numbered", F.when((F.size("pair") > 0) | (F.size("gone") > 0), _numbered(F.col("chunks"))))
    place = lambda line: F.shiftright(line["id"], 32).cast("int")
    stays = F.filter("numbered", lambda line: ~F.array_contains("gone", place(line)) & ~F.array_contains("lost", line["id"]))
    out = out.withColumn("stays", F.when((F.size("gone") > 0) | (F.size("lost") > 0), stays))
    same = F.col("stays").isNull()
    touched = F.array_distinct(F.concat("gone", F.transform("lost", lambda x: F.shiftright(x, 32).cast("int"))))
    pairs = F.filter(_pairs(F.col("numbered"), lambda a, b: F.struct(a["id"].alias("id"), a["line"].alias("a"), b["line"].alias("b"))), lambda p: F.array_contains("pair", p["id"]))
    shared = F.concat(F.filter("chunks", lambda c, i: F.array_contains("met", i)),
                      F.when(F.size("pair") > 0, F.transform(pairs, lambda p: _both(p["a"], p["b"]))).otherwise(F.array().cast("array<string>")))
    out = stored(out.select(
        "doc_id", F.when(same, F.col("text")).otherwise(_plain(F.array_join(F.transform("stays", lambda line: line["line"]), "\n"))).alias("text"),
        F.when(same, 0).otherwise(F.size(touched)).cast("long").alias("removed_chunks"),
        F.when(same, 0).otherwise(F.size("numbered") - F.size("stays")).cast("long").alias("removed_lines"),
        F.when(~same, F.length("text")).alias("before"), F.when(found, shared).alias("shared")), "cleaned", "zstd")
    _compare_bytes(out)
    return out.select("doc_id", "text", "removed_chunks", "removed_lines",
                      F.coalesce(F.col("before") - F.length("text"), F.lit(0)).cast("long").alias("removed_chars"))


def _repeated(rows: DataFrame, place: str) -> DataFrame:
    """What stands in more than one place, by its hashes (rh, rc), and the first of them."""
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_file", "_at", place)
    found = rows.groupBy("h", "check").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first")).filter("n > 1")
    return stored(found.select(F.col("h").alias("rh"), F.col("check").alias("rc"), "first"), "repeated", "zstd")


def _is(first: Column, place: str) -> Column:
    return (F.col("_file") == first["_file"]) & (F.col("_at") == first["_at"]) & (F.col(place) == first[place])


def _blank(text: Column) -> Column:
    return F.octet_length(F.ltrim(text, F.lit(_BLANK))) == 0


def _spaced(text: Column, spaces: int) -> Column:
    """Whether ``text`` has so many spaces; reads no further than the last of them."""
    return F.octet_length(F.substring_index(text, " ", spaces)) < F.octet_length(text)


def _long(line: Column) -> Column:
    """Fifty words or more, told by their spaces."""
    return (F.octet_length(line) >= 2 * LONG_WORDS - 1) & _spaced(line, LONG_WORDS - 1)


def _hashes(chunk: Column) -> list[Column]:
    return [F.xxhash64(chunk).alias("h"), F.xxhash64(F.octet_length(chunk), F.lit("chunk"), chunk).alias("check")]


def _compare_bytes(cleaned: DataFrame) -> None:
    """Stops where chunks that share both hashes are not the same bytes; equal ones are counted where they are read."""
    texts = cleaned.select(F.explode("shared").alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    unlike = texts.groupBy(*_hashes(F.col("chunk"))).agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    if unlike.limit(1).count():
        raise ValueError("two different chunks share both hashes")
