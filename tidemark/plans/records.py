"""Source, manifest and note queries."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timeutil as tu
from ..operators import notes as nt
from ..operators.timeline import Timeline, previous, running
from ..sources import manifest as mf
from ..session import ensure_checkpoint_dir
from ..sources import tables as tb
from .registry import query
from .resampling import DAY_US


def shared_path(spark):
    """A new folder for one run, where executors share files."""
    return f"{ensure_checkpoint_dir(spark)}/query-{uuid.uuid4().hex}"


@query("recordings_from_csv", "A01", "SELECT CAST(user_id AS VARCHAR) AS recording_id, event_id, value FROM events")
def _(t):
    # one folder per recording, as the device leaves them, then read back
    root = f"{shared_path(t.spark)}/csv"
    tb.write_csv_recordings(t.events.select(F.col("user_id").alias("recording"), "event_id", "value"), root)
    found = tb.read_recordings(t.spark, root, "*.csv", T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())]))
    return found.select(F.regexp_extract("recording_id", r"(\d+)$", 1).alias("recording_id"), "event_id", "value")


@query("tables_stacked", "A02", """
SELECT 'customer.parquet' AS origin, c_custkey AS id, c_name AS name, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT 'part.parquet', p_partkey, p_name, p_brand FROM part
""")
def _(t):
    origin = F.regexp_extract("_metadata.file_path", r"([a-z]+\.parquet)(/[^/]*)?$", 1).alias("origin")
    return tb.union_recordings([t.customer.select(origin, F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
                                t.part.select(origin, F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))])


@query("recordings_replaced", "A13", "SELECT user_id, count(*) AS n, round(sum(CASE WHEN user_id % 3 = 0 THEN value + 1 ELSE value END), 4) AS total FROM events GROUP BY user_id")
def _(t):
    # all recordings, then a third of them anew: only these are replaced
    root = f"{shared_path(t.spark)}/recordings"
    rows = t.events.select("user_id", "event_id", "value")
    tb.write_recordings(rows, root, "user_id")
    tb.write_recordings(rows.filter("user_id % 3 = 0").withColumn("value", F.col("value") + 1), root, "user_id")
    back = t.spark.read.parquet(root)
    return back.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("files_of_tables", "A17", "SELECT 'orders.parquet' AS name, count(*) > 0 AS filled FROM orders UNION ALL SELECT 'part.parquet', count(*) > 0 FROM part")
def _(t):
    files = tb.list_files(t.spark, f"{t.folder}/*.parquet").filter(F.col("name").isin("orders.parquet", "part.parquet"))
    return files.select("name", (F.col("length") > 0).alias("filled"))


@query("document_find", "A03", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def _(t):
    return tb.find(t.documents, (F.col("lang") == "en") & (F.col("n_chars") > 500), ["doc_id", "lang", "n_chars"], [F.col("doc_id")])


@query("event_scan", "A04", "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('view', 'click', 'error') AND event_type NOT IN ('click') AND user_id = 7")
def _(t):
    return tb.scan_events(t.events, "event_type", allow=["view", "click", "error"], deny=["click"], equals={"user_id": 7}).select("event_id", "event_type", "user_id")


@query("wake_event_scan", "A05", """
SELECT ts AS "at", 'log' AS source, 1 AS duration, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
UNION ALL SELECT max(ts), 'manual', 1, strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events
""")
def _(t):
    manual = t.events.agg(F.max("ts").alias("ts"))
    return tb.scan_wake_events(t.events, "ts", "event_type", start=F.expr("timestamp_ntz'2024-01-05'"), end=F.expr("timestamp_ntz'2024-01-20'"), kind="error", manual=manual)


@query("day_map_columns", "A06 A08", """
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 2 = 0 THEN value ELSE CAST(user_id AS DOUBLE) END AS "night:score" FROM events
""")
def _(t):
    doc = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "night:score'),
                   F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('": '), F.col("value").cast("string"))).otherwise(F.concat(F.lit('_CONVERT_TO_DAY_AND_NIGHT_OF": '), F.col("user_id").cast("string"))),
                   F.lit("}"))
    return tb.day_columns(t.events.select("event_id", doc.alias("doc")), "doc", ["k", "night:score"], keep=["event_id"])


@query("flattened_documents", "A07", """
SELECT event_id, 'props_k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'who_id', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'list_0', event_type FROM events UNION ALL SELECT event_id, 'list_1_deep', CAST(event_id % 7 AS VARCHAR) FROM events
""")
def _(t):
    doc = F.concat(F.lit('{"props": '), F.col("props"), F.lit(', "who": {"id": '), F.col("user_id").cast("string"), F.lit('}, "list": ["'), F.col("event_type"),
                   F.lit('", {"deep": '), (F.col("event_id") % 7).cast("string"), F.lit("}]}"))
    return tb.flatten_documents(t.events.select("event_id", doc.alias("doc")), ["event_id"], "doc")


@query("reviews_wide", "A09", """
WITH r AS (SELECT user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS type, user_id, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS rn FROM events)
SELECT day, max('ok' || user_id) FILTER (type = 'view') AS view_status, max(CAST(value AS VARCHAR)) FILTER (type = 'view') AS view_score, max('ok' || user_id) FILTER (type = 'click') AS click_status,
  max(CAST(value AS VARCHAR)) FILTER (type = 'click') AS click_score FROM r WHERE rn = 1 GROUP BY day
""")
def _(t):
    # every review of a person's day, in order; the first of a kind counts
    listed = t.events.groupBy(F.concat_ws("|", "user_id", F.to_date("ts")).alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("event_type").alias("type"), "user_id", "value"))).alias("l"))
    days = listed.select("day", F.transform("l", lambda x: F.struct(
        x["type"].alias("type"), F.concat(F.lit("ok"), x["user_id"]).alias("status"), F.create_map(F.lit("score"), x["value"].cast("string")).alias("value"))).alias("reviews"))
    return tb.reviews_wide(days, "day", "reviews", ["view", "click"], ["score"])


@query("reading_gaps", "A10 B04", """
WITH p AS (SELECT user_id, ts, event_id, least(floor(value), 60) AS secs FROM events),
l AS (SELECT *, epoch_us(ts) - last_value(CASE WHEN secs < 60 THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM p)
SELECT event_id, c_name AS title, gap / 1000000 AS gap_seconds, CAST(CASE WHEN hour(ts) < 4 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS DATE) AS day FROM l LEFT JOIN customer ON c_custkey = user_id
""")
def _(t):
    # pages whose time stands at the cap do not count as the row before
    at = F.when(F.least(F.floor("value"), F.lit(60)) < 60, F.col("us"))
    pages = t.timed.select("user_id", "us", "event_id", "ts", at.alias("below_cap"))
    line = Timeline.every(["user_id"], ["us", "event_id"], 7 * DAY_US)
    seen = running(previous(pages, line, just_before="below_cap"), line, {"p": ("last", F.col("just_before"))})
    titled = seen.join(t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("title")), "user_id", "left")
    return titled.select("event_id", "title", ((F.col("us") - F.col("p")) / 1_000_000).alias("gap_seconds"), tu.logical_date(F.col("ts"), 4).alias("day"))


@query("text_records", "A11", """
SELECT event_id, 0 AS record, CAST(ts AS DATE) AS day, strftime(ts, '%H:%M') AS clock, CAST(90 + user_id % 60 AS INTEGER) AS high, CAST(50 + event_id % 40 AS INTEGER) AS low, CAST(40 + event_id % 99 AS INTEGER) AS pulse FROM events
UNION ALL SELECT event_id, 1, CAST(ts AS DATE) + 1, strftime(ts, '%H:%M'), CAST(91 + user_id % 60 AS INTEGER), CAST(51 + event_id % 40 AS INTEGER), CAST(41 + event_id % 99 AS INTEGER) FROM events
""")
def _(t):
    def rec(plus):
        return F.format_string("on %s at %s: %d / %d pulse %d;", F.date_format(F.date_add("ts", plus), "yyyy-MM-dd"), F.date_format("ts", "HH:mm"),
                               90 + plus + F.col("user_id") % 60, 50 + plus + F.col("event_id") % 40, 40 + plus + F.col("event_id") % 99)
    pages = t.events.select("event_id", F.concat(F.lit("report\n"), rec(0), F.lit(" noise 12/3 "), rec(1)).alias("text"))
    return tb.text_records(pages, ["event_id"], "text", r"on (\d{4}-\d{2}-\d{2}) at (\d{2}:\d{2}): (\d+) / (\d+) pulse (\d+);",
                           [("day", "date"), ("clock", "string"), ("high", "int"), ("low", "int"), ("pulse", "int")])


@query("device_line_decode", "A12", """
WITH l AS (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) - 20000 AS a, 30 - event_id % 60 AS g FROM events WHERE event_id % 50 <> 0)
SELECT event_id, CAST(event_id % 256 AS INTEGER) AS counter, round(a * (4500000.0::DOUBLE / 24 / 8388607), 6) AS ch1, round(-a * (4500000.0::DOUBLE / 24 / 8388607), 6) AS ch2, g AS acc1 FROM l
""")
def _(t):
    a = F.floor(F.col("value") * 1000) - 20000
    g = 30 - F.col("event_id") % 60

    def field(v, bits):
        return F.lpad(F.hex(F.pmod(v, F.lit(1 << bits))), bits // 4, "0")

    line = F.when(F.col("event_id") % 50 == 0, F.lit("%STOP")).otherwise(F.concat_ws(",", field(F.col("event_id") % 256, 8), field(a, 24), field(-a, 24), field(g, 16)))
    out = tb.decode_device_lines(t.events.select("event_id", line.alias("line")), ["event_id"], "line", 2, 1)
    return out.select("event_id", "counter", F.round("ch1", 6).alias("ch1"), F.round("ch2", 6).alias("ch2"), "acc1")


@query("night_documents", "A14", """
SELECT user_id, to_json({'user_id': user_id, 'stats': {'events': count(*), 'errors': count(*) FILTER (event_type = 'error')}, 'first': min(event_type)}) AS document FROM events GROUP BY user_id
""")
def _(t):
    rows = t.events.groupBy("user_id").agg(F.struct(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")).alias("stats"), F.min("event_type").alias("first"))
    return rows.select("user_id", tb.as_document(["user_id", "stats", "first"]).cast("string").alias("document"))


@query("stale_partitions", "A15", """
WITH w AS (SELECT DISTINCT user_id FROM events), b AS (SELECT user_id, max(ts) AS built_at FROM events WHERE event_type = 'view' GROUP BY user_id HAVING count(*) > 8), u AS (SELECT user_id, max(ts) AS up FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT * FROM (SELECT user_id, CASE WHEN user_id = 3 THEN 'forced' WHEN built_at IS NULL THEN 'missing' WHEN built_at < TIMESTAMP '2024-01-20' THEN 'older than code' WHEN built_at < up THEN 'older than upstream' END AS reason
  FROM w LEFT JOIN b USING (user_id) LEFT JOIN u USING (user_id)) WHERE reason IS NOT NULL
""")
def _(t):
    from datetime import datetime

    e = t.events
    built = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("built_at"), F.count(F.lit(1)).alias("k")).filter("k > 8").drop("k")
    upstream = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("built_at"))
    return mf.stale_partitions(e.select("user_id").distinct(), built, upstream, "user_id", built_at="built_at", code_cutoff=datetime(2024, 1, 20), forced=F.col("user_id") == 3)


@query("changed_content", "A16", """
WITH m AS (SELECT l_orderkey, l_returnflag, md5(coalesce(length(l_partkey::VARCHAR) || ':' || l_partkey, '-') || coalesce(length(l_linenumber::VARCHAR) || ':' || l_linenumber, '-') || coalesce(length(l_returnflag) || ':' || l_returnflag, '-')) AS m FROM lineitem),
h AS (SELECT l_orderkey, l_returnflag, CAST('0x' || substr(m, 1, 16) AS UBIGINT)::HUGEINT AS h, CAST('0x' || substr(m, 17, 16) AS UBIGINT)::HUGEINT AS l FROM m),
n AS (SELECT l_orderkey, md5(count(*) || '-' || CAST(sum(h) AS VARCHAR) || '-' || CAST(sum(l) AS VARCHAR)) AS digest FROM h GROUP BY 1),
o AS (SELECT l_orderkey, md5(count(*) || '-' || CAST(sum(h) AS VARCHAR) || '-' || CAST(sum(l) AS VARCHAR)) AS digest FROM h WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT l_orderkey, digest FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.l_orderkey = n.l_orderkey AND o.digest = n.digest)
""")
def _(t):
    columns = ["l_partkey", "l_linenumber", "l_returnflag"]
    now = mf.content_digests(t.lineitem, ["l_orderkey"], columns)
    return mf.changed(now, mf.content_digests(t.lineitem.filter("l_returnflag <> 'R'"), ["l_orderkey"], columns), ["l_orderkey"]).select("l_orderkey", "digest")


# ---- notes

@query("sanitised_notes", "N01", """
SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS id FROM pages
""")
def _(t):
    return t.pages.select("page_id", nt.safe_id(F.col("url")).alias("id"))


@query("normalised_note_times", "N01", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written FROM events")
def _(t):
    return t.events.select("event_id", nt.iso_z(F.col("ts")).alias("written"))


@query("note_page", "N02", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def _(t):
    ranged = t.events.filter("ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-25'").select("event_id", "ts")
    return nt.page(ranged, [F.desc("ts"), F.col("event_id")], offset=50, limit=25)


@query("note_search", "N03", "SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(text), 'src3') OR contains(lower(source), 'src3') OR contains(lower(lang), 'thing') OR contains(lower(source), 'thing')")
def _(t):
    notes = t.documents.withColumn("tags", F.array("lang", "source"))
    return nt.search(notes, ["Thing", "SRC3"], "text", "tags").select("doc_id")


@query("notes_per_day", "N04", "SELECT CAST(ts AS DATE) AS day, count(*) AS notes, count(c_custkey) AS matched, count(*) - count(c_custkey) AS unmatched FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id GROUP BY 1")
def _(t):
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("hit"))
    return t.events.join(known, "user_id", "left").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("notes"), F.count("hit").alias("matched"), (F.count(F.lit(1)) - F.count("hit")).alias("unmatched"))


@query("keyword_search", "N05", """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents),
i AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('the', 'and', 'was') GROUP BY ALL)
SELECT doc_id, count(*) AS matched, CAST(sum(tf) AS BIGINT) AS occurrences FROM i GROUP BY doc_id ORDER BY matched DESC, occurrences DESC, doc_id LIMIT 50
""")
def _(t):
    return nt.keyword_search(nt.terms(t.documents, ["doc_id"], "text"), ["doc_id"], ["the", "And", "was"], 50)


@query("nearest_vectors", "N06", """
WITH v AS (SELECT vec_id, label, i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
q AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL), s AS (SELECT q.label, vec_id, round(sum(x * m), 9) AS score FROM v JOIN q USING (i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(label AS VARCHAR) AS query, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 100
""")
def _(t):
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # ten labels, one mean vector each
    means: dict[str, list] = {}
    for r in cells.orderBy("label", "i").collect():
        means.setdefault(str(r["label"]), []).append(r["m"])
    return nt.nearest_vectors(t.embeddings, "vec_id", "embedding", means, 100)


@query("notes_with_tag_like", "N07", "SELECT doc_id, source FROM documents WHERE contains(source, 'c1') OR contains(lang, 'c1')")
def _(t):
    return nt.with_tag_like(t.documents.withColumn("tags", F.array("lang", "source")), "tags", "c1").select("doc_id", "source")
