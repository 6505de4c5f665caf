"""Temporal pattern and rule queries."""

from pyspark.sql import functions as F

from ..operators import mining as mi
from .registry import query
from .resampling import SIGNAL, signal, signal_line
from .resampling import DAY_US, HOUR_US

MIN = 60_000_000
E5 = "e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type AS kind, CAST(ts AS DATE) AS day FROM events)"


def _stream(t):
    return t.timed.select("event_id", "user_id", "us", F.col("event_type").alias("kind"), F.to_date("ts").alias("day"))


PAIR = f"pr AS (SELECT a.kind AS first, b.kind AS second, (b.us - a.us) / 60000000 AS gap, CAST(make_timestamp(b.us) AS DATE) AS day FROM e a JOIN e b ON a.user_id = b.user_id AND a.kind <> b.kind AND b.us > a.us AND b.us - a.us <= {24 * HOUR_US})"


@query("bounded_gap_episodes", "K10 K12", f"WITH {E5}, {PAIR}," + """
s AS (SELECT first, second, count(*) AS n, avg(gap) AS g, stddev_pop(gap) AS sd, min(gap) AS mn FROM pr GROUP BY ALL HAVING count(*) >= 5),
d AS (SELECT first, second, day, day - CAST(row_number() OVER (PARTITION BY first, second ORDER BY day) AS INTEGER) AS run FROM (SELECT DISTINCT first, second, day FROM pr)),
k AS (SELECT first, second, max(c) AS streak FROM (SELECT first, second, run, count(*) AS c FROM d GROUP BY ALL) GROUP BY ALL)
SELECT first, second, n AS occurrences, round(g, 6) AS mean_gap, round(sd, 5) AS std_gap, round(mn, 6) AS min_gap, streak FROM s JOIN k USING (first, second)
""")
def _(t):
    out = mi.bounded_gap_episodes(_stream(t), ["user_id"], "us", "kind", "event_id", gap=24 * HOUR_US, at_least=5, chunk=7 * DAY_US)
    return out.select("first", "second", "occurrences", F.round("mean_gap", 6).alias("mean_gap"), F.round("std_gap", 5).alias("std_gap"), F.round("min_gap", 6).alias("min_gap"), "streak")


@query("bounded_gap_triples", "K10", f"WITH {E5}," + f"""
p2 AS (SELECT a.user_id, a.kind AS first, b.kind AS middle, b.us AS us2 FROM e a JOIN e b ON a.user_id = b.user_id AND a.kind <> b.kind AND b.us > a.us AND b.us - a.us <= {12 * HOUR_US}),
fq AS (SELECT first, middle FROM p2 GROUP BY ALL HAVING count(*) >= 5)
SELECT first, middle, kind AS third, count(*) AS occurrences FROM p2 JOIN e c ON c.user_id = p2.user_id AND c.us > us2 AND c.us - us2 <= {12 * HOUR_US} AND c.kind <> first AND c.kind <> middle
WHERE (first, middle) IN (SELECT (first, middle) FROM fq) AND (middle, c.kind) IN (SELECT (first, middle) FROM fq) GROUP BY ALL HAVING count(*) >= 5
""")
def _(t):
    return mi.triple_counts(_stream(t), ["user_id"], "us", "kind", "event_id", gap=12 * HOUR_US, at_least=5, chunk=7 * DAY_US)


@query("same_day_patterns", "K11 K12", f"WITH {E5}," + f"""
pr AS (SELECT a.user_id, a.day, a.kind AS first, b.kind AS second, (b.us - a.us) / 60000000 AS gap FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND b.us - a.us BETWEEN {5 * MIN} AND {480 * MIN}),
s AS (SELECT first, second, count(*) AS n, avg(gap) AS g, stddev_pop(gap) AS sd, min(gap) AS mn, count(DISTINCT (user_id, day)) AS dd FROM pr GROUP BY ALL HAVING count(*) >= 5),
b AS (SELECT first, second, count(*) AS k FROM pr JOIN s USING (first, second) WHERE gap >= greatest(0, g - sd) AND gap <= g + sd GROUP BY ALL),
tt AS (SELECT count(DISTINCT (user_id, day)) AS n FROM e), pk AS (SELECT kind, count(DISTINCT (user_id, day)) AS p FROM e GROUP BY kind),
d AS (SELECT first, second, day, day - CAST(row_number() OVER (PARTITION BY first, second ORDER BY day) AS INTEGER) AS run FROM (SELECT DISTINCT first, second, day FROM pr)),
k AS (SELECT first, second, max(c) AS streak FROM (SELECT first, second, run, count(*) AS c FROM d GROUP BY ALL) GROUP BY ALL)
SELECT s.first, s.second, s.n AS occurrences, round(g, 6) AS mean_gap, round(sd, 5) AS std_gap, round(mn, 6) AS min_gap, round(b.k / s.n, 6) AS band_share, round(1 - sd / g, 6) AS consistency,
  round(dd / tt.n, 6) AS support, round(dd * tt.n / (a.p * c.p), 6) AS lift, streak
FROM s JOIN b USING (first, second) JOIN k USING (first, second) JOIN pk a ON a.kind = s.first JOIN pk c ON c.kind = s.second, tt
""")
def _(t):
    out = mi.same_day_patterns(_stream(t), ["user_id"], "us", "kind", "event_id", "day", lo=5 * MIN, hi=480 * MIN, at_least=5, chunk=DAY_US)
    return out.select("first", "second", "occurrences", F.round("mean_gap", 6).alias("mean_gap"), F.round("std_gap", 5).alias("std_gap"),
                      *[F.round(c, 6).alias(c) for c in ("min_gap", "band_share", "consistency", "support", "lift")], "streak")


@query("same_day_triples", "K11", f"WITH {E5}," + f"""
p2 AS (SELECT a.user_id, a.day, a.kind AS first, b.kind AS middle, b.us AS us2 FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.kind <> b.kind AND b.us - a.us BETWEEN {5 * MIN} AND {480 * MIN}),
fq AS (SELECT first, middle FROM p2 GROUP BY ALL HAVING count(*) >= 3)
SELECT first, middle, kind AS third, count(*) AS occurrences FROM p2 JOIN e c ON c.user_id = p2.user_id AND c.day = p2.day AND c.us - us2 BETWEEN {5 * MIN} AND {480 * MIN} AND c.kind <> first AND c.kind <> middle
WHERE (first, middle) IN (SELECT (first, middle) FROM fq) AND (middle, c.kind) IN (SELECT (first, middle) FROM fq) GROUP BY ALL HAVING count(*) >= 3
""")
def _(t):
    return mi.same_day_triples(_stream(t), ["user_id"], "us", "kind", "event_id", "day", lo=5 * MIN, hi=480 * MIN, at_least=3, chunk=DAY_US)


@query("readable_items", "K08", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type || ' immediately followed by view' WHEN 1 THEN event_type || ' followed within 15 minutes by view' WHEN 2 THEN event_type || ' followed 15-30 minutes later by view'
  WHEN 3 THEN event_type || ' followed 30-60 minutes later by view' WHEN 4 THEN event_type || ' followed 1-2 hours later by view' WHEN 5 THEN event_type || ' followed over 2 hours later by view' ELSE event_type END AS text FROM events
""")
def _(t):
    tail = F.element_at(F.array(*[F.lit(f"_to_view_{b}") for b in mi.BUCKET_TEXT], F.lit("")), (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select("event_id", mi.readable_item(F.concat("event_type", tail)).alias("text"))


@query("day_streaks", "K12", """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), r AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM d),
c AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(n) AS streak FROM c GROUP BY user_id
""")
def _(t):
    return mi.streaks(_stream(t), ["user_id"], "day")


def _windows_sql(size, step):
    return f"""{E5}, sp AS (SELECT user_id, min(us) AS f, max(us) AS l FROM e GROUP BY user_id),
wn AS (SELECT user_id, f, unnest(range(0, CAST(ceil((l - f) / {step}) AS BIGINT))) AS "window" FROM sp)"""


SIZE = 24 * HOUR_US


@query("window_episodes", "K09", f"WITH {_windows_sql(SIZE, SIZE // 4)}," + f"""
x AS (SELECT e.*, "window", row_number() OVER (PARTITION BY e.user_id, "window" ORDER BY us, event_id) AS pos FROM wn JOIN e ON e.user_id = wn.user_id AND us >= f + "window" * {SIZE // 4} AND us < f + "window" * {SIZE // 4} + {SIZE}),
oc AS (SELECT a.user_id, a."window", a.kind AS first, b.kind AS second, count(*) AS occ FROM x a JOIN x b ON a.user_id = b.user_id AND a."window" = b."window" AND b.pos > a.pos AND b.pos <= a.pos + 3 GROUP BY ALL),
gp AS (SELECT a.user_id, a."window", a.kind AS first, b.kind AS second, count(*) AS n, sum((b.us - a.us) / 60000000) AS s, sum(((b.us - a.us) / 60000000) ** 2) AS q, min((b.us - a.us) / 60000000) AS mn
  FROM x a JOIN x b ON a.user_id = b.user_id AND a."window" = b."window" AND b.us > a.us GROUP BY ALL),
tt AS (SELECT count(DISTINCT (user_id, "window")) AS n FROM x)
SELECT first, second, CAST(sum(occ) AS BIGINT) AS occurrences, round(sum(occ) / max(tt.n), 6) AS support, round(sum(occ * s) / sum(occ * gp.n), 6) AS mean_gap,
  round(sqrt(sum(occ * q) / sum(occ * gp.n) - (sum(occ * s) / sum(occ * gp.n)) ** 2), 5) AS std_gap, round(min(mn), 6) AS min_gap
FROM oc LEFT JOIN gp USING (user_id, "window", first, second), tt GROUP BY ALL
""")
def _(t):
    out = mi.window_episodes(_stream(t), ["user_id"], "us", "kind", "event_id", size=SIZE, chunk=7 * DAY_US)
    return out.select("first", "second", "occurrences", F.round("support", 6).alias("support"), F.round("mean_gap", 6).alias("mean_gap"), F.round("std_gap", 5).alias("std_gap"), F.round("min_gap", 6).alias("min_gap"))


@query("window_triples", "K09", f"WITH {_windows_sql(SIZE, SIZE // 4)}," + f"""
x AS (SELECT e.*, "window", row_number() OVER (PARTITION BY e.user_id, "window" ORDER BY us, event_id) AS pos FROM wn JOIN e ON e.user_id = wn.user_id AND us >= f + "window" * {SIZE // 4} AND us < f + "window" * {SIZE // 4} + {SIZE}),
tt AS (SELECT count(DISTINCT (user_id, "window")) AS n FROM x)
SELECT a.kind AS first, b.kind AS second, c.kind AS third, count(*) AS occurrences, round(count(*) / max(tt.n), 6) AS support
FROM x a JOIN x b ON a.user_id = b.user_id AND a."window" = b."window" AND b.pos > a.pos AND b.pos <= a.pos + 3 JOIN x c ON c.user_id = b.user_id AND c."window" = b."window" AND c.pos > b.pos AND c.pos <= b.pos + 3, tt GROUP BY ALL
""")
def _(t):
    return mi.window_triples(_stream(t), ["user_id"], "us", "kind", "event_id", size=SIZE, chunk=7 * DAY_US).withColumn("support", F.round("support", 6))


@query("sliding_transactions", "K01", f"WITH {_windows_sql(12 * HOUR_US, 6 * HOUR_US)}," + f"""
sq AS (SELECT b.user_id, b.us, a.kind || '_to_' || b.kind || '_' || CASE WHEN (b.us - a.us) // 60000000 < 5 THEN 'immediate' WHEN (b.us - a.us) // 60000000 < 15 THEN 'under_15min' WHEN (b.us - a.us) // 60000000 < 30 THEN '15_30min'
  WHEN (b.us - a.us) // 60000000 < 60 THEN '30_60min' WHEN (b.us - a.us) // 60000000 < 120 THEN '1_2hours' ELSE 'over_2hours' END AS item
  FROM e a JOIN e b ON a.user_id = b.user_id AND a.us < b.us AND b.us - a.us <= {2 * HOUR_US}),
it AS (SELECT user_id, us, kind AS item FROM e UNION ALL SELECT * FROM sq)
SELECT wn.user_id, "window", string_agg(DISTINCT item, '|' ORDER BY item) AS items FROM wn JOIN it ON it.user_id = wn.user_id AND us >= f + "window" * {6 * HOUR_US} AND us < f + "window" * {6 * HOUR_US} + {12 * HOUR_US} GROUP BY ALL
""")
def _(t):
    rows = mi.sliding_transactions(_stream(t), ["user_id"], "us", "kind", "event_id", size=12 * HOUR_US, chunk=7 * DAY_US)
    return mi.baskets(rows, ["user_id", "window"]).select("user_id", "window", F.array_join("items", "|").alias("items"))


BASKET = "it AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type AS item FROM events), tt AS (SELECT count(DISTINCT (user_id, day)) AS n FROM it)"
SETS = BASKET + """,
gs AS (SELECT [item] AS items, user_id, day FROM it UNION ALL SELECT list_append(gs.items, it.item), gs.user_id, gs.day FROM gs JOIN it ON it.user_id = gs.user_id AND it.day = gs.day AND it.item > gs.items[-1]),
fs AS (SELECT * FROM (SELECT items, count(*) AS freq FROM gs GROUP BY items), tt WHERE freq >= 0.01 * n),
"""


def _rules_sql(longest: str = "true") -> str:
    return SETS + f"""
ru AS (
  SELECT list_filter(items, lambda x, i: (bits >> (i - 1)) & 1 = 1) AS antecedent, list_filter(items, lambda x, i: (bits >> (i - 1)) & 1 = 0) AS consequent, freq, n
  FROM fs, LATERAL (SELECT unnest(range(1, (1 << len(items)) - 1)) AS bits) WHERE {longest}),
rl AS (SELECT antecedent, consequent, ru.freq / ru.n AS support, ru.freq / a.freq AS confidence, (ru.freq / a.freq) / (c.freq / ru.n) AS lift FROM ru JOIN fs a ON a.items = antecedent JOIN fs c ON c.items = consequent)
"""


RULES = _rules_sql()


def _sets(t):
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("item"))
    return mi.frequent_itemsets(mi.baskets(rows, ["user_id", "day"]), "items", 0.01)


@query("frequent_itemsets", "K02", f"WITH RECURSIVE {SETS.rstrip().rstrip(',')} SELECT array_to_string(items, '|') AS items, freq FROM fs")
def _(t):
    sets, _ = _sets(t)
    return sets.select(F.array_join("items", "|").alias("items"), "freq")


@query("association_rules", "K02", f"WITH RECURSIVE {RULES} SELECT array_to_string(antecedent, '|') AS antecedent, array_to_string(consequent, '|') AS consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rl WHERE confidence >= 0.05")
def _(t):
    out = mi.association_rules(*_sets(t), min_confidence=0.05)
    return out.select(F.array_join("antecedent", "|").alias("antecedent"), F.array_join("consequent", "|").alias("consequent"), *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


@query("rules_of_up_to_three", "K05", f"WITH RECURSIVE {_rules_sql('len(items) <= 3')} SELECT array_to_string(antecedent, '|') AS antecedent, array_to_string(consequent, '|') AS consequent, round(lift, 6) AS lift FROM rl")
def _(t):
    sets, total = _sets(t)
    out = mi.association_rules(sets.filter(F.size("items") <= 3), total)
    return out.select(F.array_join("antecedent", "|").alias("antecedent"), F.array_join("consequent", "|").alias("consequent"), F.round("lift", 6).alias("lift"))


@query("outcome_rules", "K07", f"WITH RECURSIVE {RULES} SELECT array_to_string(antecedent, '|') AS antecedent, round(lift, 6) AS lift FROM rl WHERE consequent = ['purchase'] AND NOT list_contains(antecedent, 'error')")
def _(t):
    out = mi.rules_for(mi.association_rules(*_sets(t)), F.col("consequent")[0] == "purchase", interventions=["view", "click", "signup"])
    return out.select(F.array_join("antecedent", "|").alias("antecedent"), F.round("lift", 6).alias("lift"))


@query("top_rules", "K08", f"WITH RECURSIVE {RULES} SELECT printf('When %s then %s (confidence %.1f%%, lift %.2f)', array_to_string(antecedent, ' and '), array_to_string(consequent, ' and '), confidence * 100, lift) AS text FROM rl ORDER BY lift DESC, confidence DESC, text LIMIT 8")
def _(t):
    return mi.top_rules(mi.association_rules(*_sets(t)), 8).select("text")


@query("equal_width_bins", "K03", """
WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(least(greatest(ceil((l_extendedprice - lo) / ((hi - lo) / 5)), 1), 5) AS INTEGER) AS bin FROM lineitem, m
""")
def _(t):
    return mi.equal_width_bins(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 5).drop("l_extendedprice")


@query("named_bands", "K04", """
WITH b AS (SELECT event_id, CASE WHEN value > 0 AND value <= 5 THEN 'low' WHEN value > 5 AND value <= 30 THEN 'mid' WHEN value > 30 AND value <= 100 THEN 'high' END AS band FROM events)
SELECT event_id, band, CAST(coalesce(band = 'low', false) AS INTEGER) AS is_low, CAST(coalesce(band = 'high', false) AS INTEGER) AS is_high FROM b
""")
def _(t):
    band = mi.named_bands(F.col("value"), [0, 5, 30, 100], ["low", "mid", "high"])
    b = t.events.select("event_id", band.alias("band"))
    return b.withColumns({f"is_{n}": F.coalesce(F.col("band") == n, F.lit(False)).cast("int") for n in ("low", "high")})


@query("indicator_items", "K05", """
WITH w AS (SELECT event_id, CASE WHEN value >= 5 THEN value / 100 END AS a, CASE WHEN user_id % 3 <> 0 THEN (user_id % 2)::DOUBLE END AS b FROM events), m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM w)
SELECT event_id, concat_ws('|', CASE WHEN coalesce(a, ma) > 0.5 THEN 'a' END, CASE WHEN a IS NULL THEN 'a_missing' END, CASE WHEN coalesce(b, mb) > 0.5 THEN 'b' END, CASE WHEN b IS NULL THEN 'b_missing' END) AS items FROM w, m
""")
def _(t):
    w = t.events.select("event_id", F.when(F.col("value") >= 5, F.col("value") / 100).alias("a"), F.when(F.col("user_id") % 3 != 0, (F.col("user_id") % 2).cast("double")).alias("b"))
    return mi.indicator_items(w, ["event_id"], ["a", "b"]).select("event_id", F.array_join("items", "|").alias("items"))


@query("widest_intervals", "K06", """
SELECT 'l_quantity' AS "column", min(l_quantity) AS low, max(l_quantity) AS high, count(l_quantity) / count(*) AS support FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), count(l_tax) / count(*) FROM lineitem
""")
def _(t):
    return mi.widest_intervals(t.lineitem, ["l_quantity", "l_tax"], 0.1)


MOTIF_WINDOWS = f"""WITH {SIGNAL},
w AS (SELECT rec, sample_no AS pos, list(value) OVER (PARTITION BY rec ORDER BY sample_no ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v FROM sg),
z AS (SELECT rec, pos, list_transform(v, lambda x: (x - list_avg(v)) / list_aggregate(v, 'stddev_pop')) AS z FROM w WHERE len(v) = 16),
p AS (SELECT a.rec, a.pos, min(struct_pack(distance := round(list_distance(a.z, b.z), 9), other := b.pos)) AS b FROM z a JOIN z b ON a.rec = b.rec AND abs(a.pos - b.pos) > 4 GROUP BY a.rec, a.pos),
r AS (SELECT rec, pos, b, row_number() OVER (PARTITION BY rec ORDER BY b.distance, pos) AS rank FROM p)
"""


@query("motifs", "K13", MOTIF_WINDOWS + "SELECT rec, rank, pos AS \"at\", b.other AS other, round(b.distance, 6) AS distance FROM r WHERE rank <= 3")
def _(t):
    from ..operators.motifs import motifs

    return motifs(signal(t), signal_line(), "value", 16, 3).select("rec", "rank", "at", "other", F.round("distance", 6).alias("distance"))
