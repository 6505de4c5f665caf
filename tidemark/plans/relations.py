"""Queries of relations in closed form, membership and note retrieval."""

from pyspark.sql import functions as F

from ..operators import notes as nt
from ..operators import relations as rl
from .registry import query
from .testing import XY, _xy

#: md5 bucket of a key, as the engine-independent split makes it.
FOLD = "CAST(CAST('0x' || substr(md5({key} || '|42'), 1, 8) AS BIGINT) % 3 AS INTEGER)"


def _folded(key: str, group: str) -> str:
    return f"""
f AS (SELECT {group}, {FOLD.format(key=key)} AS fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM xy GROUP BY ALL),
t AS (SELECT f.*, sum(n) OVER w - n AS tn, sum(sx) OVER w - sx AS tx, sum(sy) OVER w - sy AS ty, sum(sxy) OVER w - sxy AS txy, sum(sxx) OVER w - sxx AS txx FROM f WINDOW w AS (PARTITION BY {group})),
l AS (SELECT *, (tn * txy - tx * ty) / (tn * txx - tx * tx) AS b FROM t), m AS (SELECT *, (ty - b * tx) / tn AS a FROM l),
v AS (SELECT {group}, count(*) AS folds, avg(1 - (syy - 2 * a * sy - 2 * b * sxy + n * a * a + 2 * a * b * sx + b * b * sxx) / (syy - sy * sy / n)) AS r2 FROM m GROUP BY {group})"""


@query("grouped_cross_validation", "M13", f"WITH {XY}, {_folded('CAST(id AS VARCHAR)', 'flag')} SELECT flag, folds, round(r2, 5) AS r2 FROM v")
def _(t):
    return rl.cross_validated_lines(_xy(t), ["flag"], "x", "y", ["id"]).withColumn("r2", F.round("r2", 5))


@query("leave_one_out", "L28", f"WITH {XY}," + """
s AS (SELECT flag, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx, sum(y * y) AS syy FROM xy GROUP BY flag),
r AS (SELECT xy.flag, id, (n * sxy - sx * sy) ** 2 / ((n * sxx - sx * sx) * (n * syy - sy * sy)) AS whole,
  ((n - 1) * (sxy - x * y) - (sx - x) * (sy - y)) ** 2 / (((n - 1) * (sxx - x * x) - (sx - x) ** 2) * ((n - 1) * (syy - y * y) - (sy - y) ** 2)) AS without FROM xy JOIN s USING (flag))
SELECT flag, id, round((without - whole) * 1000, 3) + 0.0::DOUBLE AS rise FROM r
""")
def _(t):
    return rl.leave_one_out(_xy(t), ["flag"], ["id"], "x", "y").withColumn("rise", F.round(F.col("rise") * 1000, 3))


@query("cluster_relations", "L35", f"WITH {XY}, {_folded('CAST(id AS VARCHAR)', 'flag')}," + """
k AS (SELECT flag, x, y, rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2 AS ry FROM xy),
c AS (SELECT flag, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM k GROUP BY flag),
eg AS (SELECT flag, list_sort(list_distinct([quantile_cont(x, q) FOR q IN [0.0, 0.25, 0.5, 0.75, 1.0]])) AS ex, list_sort(list_distinct([quantile_cont(y, 0.0), quantile_cont(y, 0.25), quantile_cont(y, 0.5), quantile_cont(y, 0.75), quantile_cont(y, 1.0)])) AS ey FROM xy GROUP BY flag),
bn AS (SELECT flag, greatest(len(list_filter(ex, lambda e: e < x)) - 1, 0) AS bx, greatest(len(list_filter(ey, lambda e: e < y)) - 1, 0) AS by_ FROM xy JOIN eg USING (flag)),
ce AS (SELECT flag, bx, by_, count(*) AS n FROM bn GROUP BY ALL), ma AS (SELECT *, sum(n) OVER (PARTITION BY flag) AS t, sum(n) OVER (PARTITION BY flag, bx) AS a, sum(n) OVER (PARTITION BY flag, by_) AS b FROM ce),
mi AS (SELECT flag, sum(n / t * ln(n * t / (a * b))) AS mutual FROM ma GROUP BY flag)
SELECT c.flag, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(mutual, 6) AS mutual_information, round(r2, 5) AS r2 FROM c JOIN mi USING (flag) JOIN v USING (flag)
""".replace("[quantile_cont(x, q) FOR q IN [0.0, 0.25, 0.5, 0.75, 1.0]]", "[quantile_cont(x, 0.0), quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75), quantile_cont(x, 1.0)]"))
def _(t):
    out = rl.cluster_relations(_xy(t), "flag", "x", "y", ["id"])
    return out.select("flag", "n", *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "mutual_information")], F.round("r2", 5).alias("r2"))


@query("partial_correlation_of_several", "L18", """
WITH xy AS (SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y, l_discount AS z, l_tax AS u FROM lineitem),
c AS (SELECT flag, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(x, u) AS xu, corr(y, z) AS yz, corr(y, u) AS yu, corr(z, u) AS zu FROM xy GROUP BY flag),
d AS (SELECT flag, n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS xy, (xu - xz * zu) / sqrt((1 - xz * xz) * (1 - zu * zu)) AS xu, (yu - yz * zu) / sqrt((1 - yz * yz) * (1 - zu * zu)) AS yu FROM c)
SELECT flag, n, round((xy - xu * yu) / sqrt((1 - xu * xu) * (1 - yu * yu)), 6) AS partial_r FROM d
""")
def _(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"), F.col("l_tax").alias("u"))
    return rl.partial_correlation_given(rows, ["flag"], "x", "y", ["z", "u"]).withColumn("partial_r", F.round("partial_r", 6))


@query("inverse_distance_membership", "L06", """
WITH c AS (SELECT unnest([0, 1, 2]) AS centre, unnest([0.0, 10.0, 40.0]) AS centre_at), w AS (SELECT event_id, centre, abs(value - centre_at) AS g FROM events, c),
h AS (SELECT *, min(g) OVER (PARTITION BY event_id) = 0 AS hit FROM w), m AS (SELECT *, CASE WHEN hit THEN CASE WHEN g = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / g ** 2 END AS v FROM h)
SELECT event_id, CAST(centre AS INTEGER) AS centre, round(v / sum(v) OVER (PARTITION BY event_id), 6) AS membership FROM m
""")
def _(t):
    return rl.inverse_distance_membership(t.events.select("event_id", "value"), [], ["event_id"], "value", [0.0, 10.0, 40.0]).withColumn("membership", F.round("membership", 6))


@query("uniform_bins", "L02", "WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, CAST(least(floor((value - lo) / ((hi - lo) / 6)), 5) AS INTEGER) AS bin FROM events, m")
def _(t):
    return rl.uniform_bins(t.events.select("event_id", "value"), "value", 6).select("event_id", "bin")


@query("notes_by_tag_and_day", "N05", """
WITH n AS (SELECT doc_id, text, ['lang:' || lang, source] AS tags, DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS day FROM documents)
SELECT doc_id, day FROM n WHERE list_contains(tags, 'lang:fr') AND list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['les', 'est']) ORDER BY day, doc_id
""")
def _(t):
    tags = F.array(F.concat(F.lit("lang:"), F.col("lang")), F.col("source")).alias("tags")
    notes = t.documents.select("doc_id", "text", tags, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("day"))
    return nt.retrieve_notes(notes, "text", ["les", "est"], "tags", "lang:fr", ["day", "doc_id"]).select("doc_id", "day")
