"""Chat formatting: render turns, reparse, compare, and escape what does not come back.

The grammar is ``(OPEN role "\\n" body CLOSE "\\n")*``. A parser that knows nothing of the source reads a rendered
conversation back. Turns are first rendered as they are; where the reparse differs from the source, the turns that
do not survive alone are escaped, and should the whole still differ, all of them; a conversation that would differ
even then raises an error. The escape adds a backslash inside ``<|`` (and inside ``<\\|``, so that it can be undone)
and percent codes in roles; the parser always undoes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_in(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def render(role: Column, body: Column) -> Column:
    """One turn in the template."""
    return F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, array<struct<role, text>>; null where it breaks the grammar."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        cut = F.locate("\n", inner)
        body = F.substring(inner, cut + 1, F.length(inner))
        fine = piece.startswith(OPEN) & (cut > 0) & ~body.contains(OPEN) & ~body.contains(CLOSE)
        role = F.substring(inner, F.lit(1), cut - 1)
        return F.when(fine, F.struct(_role_in(role).alias("role"), unescape(body).alias("text")))

    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    whole = (F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(whole, turns)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans`` and ``escaped_turns``.

    ``turns`` has conv_id, turn, role and text; other columns are left out. ``loss_spans`` are the places of the
    assistant texts in ``formatted``, in order, as (start, length) in code points from 0. Turns sort by turn (null
    last), then role, then text, so repeated rows and ties have one order. A null role or text is empty; rows of a
    null conv_id form one conversation; an empty table gives no rows. A conversation becomes one text and so one
    row; rendering and the test of each turn run before that, in the tasks that read the turns.
    """
    rows = turns.select(
        F.col("conv_id"), F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    alone = parse(render(F.col("role"), F.col("text"))).eqNullSafe(F.array(F.struct("role", "text")))
    rows = rows.withColumn("clash", ~alone)
    order = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text", "clash")
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("turns"))

    def written(hard: Column) -> Column:
        return F.transform("turns", lambda t: F.struct(
            t["role"].alias("role"),
            F.when(hard | t["clash"], _role_out(t["role"])).otherwise(t["role"]).alias("head"),
            F.when(hard | t["clash"], escape(t["text"])).otherwise(t["text"]).alias("body"),
        ))

    def joined(pieces: str) -> Column:
        return F.array_join(F.transform(pieces, lambda p: render(p["head"], p["body"])), "")

    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = chats.withColumn("pieces", written(F.lit(False))).withColumn("formatted", joined("pieces"))
    first = first.withColumn("same", parse(F.col("formatted")).eqNullSafe(source))
    # where it still differs, everything in it is escaped, and that has to come back
    second = first.withColumn("pieces", F.when(F.col("same"), F.col("pieces")).otherwise(written(F.lit(True))))
    second = second.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(joined("pieces")))
    back = F.col("same") | parse(F.col("formatted")).eqNullSafe(source)
    second = second.withColumn("formatted", F.when(back, F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        body_at = acc["at"] + len(OPEN) + F.length(p["head"]) + 1
        length = F.length(p["body"]).cast("long")
        span = F.array(F.struct(body_at.alias("start"), length.alias("length")))
        return F.struct(
            (body_at + length + len(CLOSE) + 1).alias("at"),
            F.when(p["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return second.select(
        "conv_id", "formatted",
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.size(F.filter("turns", lambda t: t["clash"])).cast("long").alias("escaped_turns"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def chat_digests(chats: DataFrame) -> DataFrame:
    """What the rendered conversations hold, read back from ``formatted`` alone."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.withColumns({"turns": parse(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped_turns",
    )
