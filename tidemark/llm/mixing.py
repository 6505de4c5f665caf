"""Mixing sources to target weights: Sainte-Lague apportionment of equal-word blocks, then seeded block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_scan, stored, text_of, with_rows

#: Words of a block, words of a shard, and how often a word may be taken.
BLOCK_WORDS, SHARD_WORDS, MOST_REPEATS = 16, 1 << 18, 3


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size), one per source.

    Sources by code point, null last, have ``weights`` in turn. All words are shared by weight; a target stops at
    MOST_REPEATS times its source's size and the excess is shared again. In order of limit over weight, the sources
    that reach their limit come first, so one running sum finds the final level. The table has a row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * MOST_REPEATS)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumns({
        "place": F.row_number().over(by_ratio),
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "sharing": F.sum("weight").over(rest),
    })
    level = F.col("left").cast("double") * F.col("weight") / F.col("sharing")
    rows = rows.withColumn("open", F.min(F.when(level <= F.col("limit"), F.col("place"))).over(every))
    rows = rows.withColumns({
        "open_left": F.max(F.when(F.col("place") == F.col("open"), F.col("left"))).over(every),
        "open_sharing": F.max(F.when(F.col("place") == F.col("open"), F.col("sharing"))).over(every),
    })
    shared = F.col("open_left").cast("double") * F.col("weight") / F.col("open_sharing")
    capped = F.col("open").isNull() | (F.col("place") < F.col("open"))
    return rows.select("source", "source_size", F.when(capped, F.col("limit").cast("double")).otherwise(shared).alias("target"))


def apportion(rows: DataFrame, group: list[str], share: str, limit: str, total: str) -> DataFrame:
    """Sainte-Lague seats: ``seats`` of each row, given its ``share``, its ``limit`` and the ``total`` seats of its group.

    Seats go one by one to the highest quotient share / (2 seats + 1). Dividing by the even price share / total and
    rounding gives all but a few of them; the few are given, or taken back, in order of quotient. A row can be out by
    no more than its part of the number of rows, so only that many of its next quotients are ranked, about two per row.
    Ties go by ``key``. ``rows`` needs a unique ``key``.
    """
    within = Window.partitionBy(*group)
    rows = rows.withColumns({"all_share": F.sum(share).over(within), "peers": F.count(F.lit(1)).over(within)})
    exact = F.when(F.col("all_share") > 0, F.col(total) * F.col(share).cast("double") / F.col("all_share")).otherwise(0.0)
    rows = rows.withColumn("even", F.least(F.floor(exact + 0.5), F.col(limit)).cast("long"))
    rows = rows.withColumn("short", F.col(total) - F.sum("even").over(within))
    steps = F.lit(1) + F.ceil(F.when(F.col("all_share") > 0, F.col("peers") * F.col(share).cast("double") / F.col("all_share")).otherwise(0.0)).cast("int")
    more = F.when(F.col("short") > 0, F.least(steps.cast("long"), F.col(limit) - F.col("even"))) \
        .when(F.col("short") < 0, F.least(steps.cast("long"), F.col("even"))).otherwise(0)
    tries = rows.filter(more > 0).select(*group, "key", share, "even", "short", F.explode(F.sequence(F.lit(1).cast("long"), more)).alias("step"))
    # the seat that a step would add, or give back
    seat = F.when(F.col("short") > 0, F.col("even") + F.col("step") - 1).otherwise(F.col("even") - F.col("step"))
    quotient = F.col(share).cast("double") / (2 * seat + 1)
    wanted = F.when(F.col("short") > 0, -quotient).otherwise(quotient)
    ranked = tries.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(wanted, "key", "step")))
    moved = ranked.filter(F.col("rank") <= F.abs("short")).groupBy(*[F.col(g).alias(f"m_{g}") for g in group], F.col("key").alias("m_key")) \
        .agg(F.sum(F.signum("short").cast("long")).alias("moved"))
    same = F.col("key") == F.col("m_key")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"m_{g}"))
    out = rows.join(moved, same, "left").withColumn("seats", F.col("even") + F.coalesce(F.col("moved"), F.lit(0)))
    return out.drop("all_share", "peers", "even", "short", "moved", "m_key", *[f"m_{g}" for g in group])


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), seed: str = "mix", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, taken, _file, _at``: words it has and words the mix takes of it.

    Each source is dealt by a seeded hash into shards of about ``shard_words`` words, each shard's documents stand in
    seeded order, and their words form blocks of ``block_words``. Blocks are apportioned to sources by target, then to
    a source's shards by words. A shard takes all its blocks as often as its quota goes round, and once more those that
    follow a seeded one, going round; since documents stand in seeded order, nearly all are taken whole. So no word is
    taken more than three times, every source comes within a few blocks of its target, and reruns agree. A hot source
    only has more shards.

    Null text has size 0, null source is a source of its own (last), a null doc_id hashes as empty text, and rows that
    repeat count one by one. A table without words takes nothing. Other columns are left out.
    """
    size = F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = with_rows(docs).select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), "_file", "_at")
    sized = stored(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(source_targets(sources, weights).withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")), "sources")

    def drawn(purpose: str, *of: Column) -> Column:
        words = [F.coalesce(c.cast("string"), F.lit("")) for c in of]
        return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(purpose), *words).cast("binary")), 1, 15), 16, 10).cast("long")

    named = sources.withColumnRenamed("source", "of_source")
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    placed = placed.withColumns({"shard": F.pmod(drawn("shard", F.col("doc_id")), F.col("shards")), "draw": drawn("order", F.col("doc_id"))})
    line = Window.partitionBy("source", "shard").orderBy("draw", F.col("doc_id").isNull(), "doc_id", "size", "_file", "_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored(placed.withColumn("start", F.sum("size").over(line) - F.col("size")).drop("draw", "shards"), "places")

    shards = placed.groupBy("source", F.col("shard").alias("key")).agg(F.sum("size").alias("words"))
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    room = shards.groupBy("source").agg((F.sum("blocks") * MOST_REPEATS).alias("room")).withColumnRenamed("source", "of_source")
    seats = sources.join(room, F.col("source").eqNullSafe(F.col("of_source"))).withColumns({
        "one": F.lit(1), "key": F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")),
        "total": F.floor(F.sum("source_size").over(Window.partitionBy()) / block_words + 0.5).cast("long"),
    })
    quotas = apportion(seats, ["one"], "target", "room", "total").select(F.col("source").alias("of_source"), F.col("seats").alias("quota"))
    shards = shards.join(quotas, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("room", F.col("blocks") * MOST_REPEATS)
    shares = apportion(shards, ["source"], "words", "room", "quota")
    shares = stored(shares.select(F.col("source").alias("of_source"), F.col("key").alias("of_shard"), "blocks", "seats"), "quotas")

    rows = placed.join(shares, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard")))
    rows = rows.withColumns({
        "rounds": F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks"))).otherwise(0).cast("long"),
        "extra": F.when(F.col("blocks") > 0, F.col("seats") % F.col("blocks")).otherwise(0).cast("long"),
    })
    # once more: blocks [from, from + extra), going round at the shard's last block
    rows = rows.withColumn("from", F.when(F.col("blocks") > 0, F.pmod(drawn("start", F.col("source"), F.col("shard")), F.col("blocks"))).otherwise(0))
    stop = F.col("from") + F.col("extra")

    def inside(low: Column, high: Column) -> Column:
        return F.greatest(F.least(high * block_words, F.col("start") + F.col("size")) - F.greatest(low * block_words, F.col("start")), F.lit(0))

    more = inside(F.col("from"), F.least(stop, F.col("blocks"))) + inside(F.lit(0), stop - F.col("blocks"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * F.col("size") + more).cast("long").alias("taken"), "_file", "_at")


def mixed_documents(docs: DataFrame, **mix) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns: whole documents, so the few that the mix
    takes in part count to the nearest whole. What is not taken, texts without words too, is gone."""
    docs = as_scan(docs)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = mix_sources(docs, **mix).filter((F.col("size") > 0) & (F.col("taken") > 0)).select(F.col("_file").alias("t_file"), F.col("_at").alias("t_at"), times.alias("t_times"))
    rows = with_rows(docs).join(taken.filter("t_times > 0"), (F.col("_file") == F.col("t_file")) & (F.col("_at") == F.col("t_at")))
    return rows.withColumn("t_copy", F.explode(F.sequence(F.lit(1), F.col("t_times")))).select(*docs.columns)
