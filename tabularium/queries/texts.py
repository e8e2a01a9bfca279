"""Text functions, extraction, formats, JSON and the streaming tail."""

from pyspark.sql import functions as F

from tabularium.functions import text as X
from tabularium.functions.numbers import comma_list
from tabularium.queries import load, query
from tabularium.sources import extract, formats
from tabularium.streaming import tail

PATH = r"regexp_replace(url, '[?#].*$', '')"


@query(rf"SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[^./]+)$', 1)) AS extension FROM pages")
def format_of_path(spark, sf):
    t = load(spark, sf, "pages")
    return t.select("page_id", X.extension(F.regexp_replace("url", "[?#].*$", "")).alias("extension"))


@query(r"SELECT CASE WHEN e = '.html' THEN 'extract' END AS level, count(*) AS n FROM (SELECT lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]*(\.[^./]+)$', 1)) AS e FROM pages) GROUP BY 1")
def format_levels(spark, sf):
    t = load(spark, sf, "pages").select(F.lower(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"/[^/]*(\.[^./]+)$", 1)).alias("extension"))
    known = F.broadcast(formats.catalogue_table(spark))  # a fixed table of some hundred rows
    return t.join(known, "extension", "left").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '\r\n?', '\n', 'g') AS t FROM documents), c AS (SELECT doc_id, t, unnest(generate_series(0, (length(t) + 499) // 500 - 1))::INTEGER AS i FROM t)
    SELECT doc_id, i AS index, substring(t, i * 500 + 1, 500) AS chunk FROM c""")
def text_chunks(spark, sf):
    return extract.text_chunks(load(spark, sf, "documents"), "doc_id", "text", 500)


@query("""WITH t AS (SELECT doc_id, text, length(text) AS n, sum(length(text)) OVER (ORDER BY doc_id) AS upto FROM documents) SELECT doc_id, substring(text, 1, least(n, 100000 - (upto - n))::INTEGER) AS text FROM t WHERE upto - n < 100000""")
def text_budget(spark, sf):
    return extract.within_budget(load(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", 100_000)


@query("""SELECT item_id, regexp_replace(replace(text, ' ', chr(13) || chr(10)), '\r\n?', chr(10), 'g') AS text, regexp_replace(text, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM benchmark""")
def newline_norm(spark, sf):
    t = load(spark, sf, "benchmark")
    return t.select("item_id", X.newline_norm(F.replace("text", F.lit(" "), F.lit("\r\n"))).alias("text"), X.safe_name(F.col("text")).alias("name"))


@query("SELECT doc_id, 'ds_' || substring(sha256(text), 1, 12) || '_' || substring(sha256(lang), 1, 4) AS dataset_id FROM documents")
def dataset_ids(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.dataset_id(F.sha2("text", 256), F.col("lang")).alias("dataset_id"))


@query("SELECT event_type, sha256('{\"kind\":\"' || event_type || '\",\"n\":' || count(*) || '}') AS digest FROM events GROUP BY event_type")
def config_hash(spark, sf):
    t = load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return t.select("event_type", X.config_hash(F.struct(F.col("event_type").alias("kind"), "n")).alias("digest"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k')::INTEGER < 20")
def json_filter(spark, sf):
    t = load(spark, sf, "events").withColumn("k", X.payload_field(F.col("props"), "k"))
    return t.where(F.col("k").cast("int") < 20).select("event_id", "k")


@query("SELECT count(*) AS rows_with_unknown FROM events WHERE len(list_filter(json_keys(props), lambda k: k NOT IN ('a', 'b'))) > 0")
def unknown_fields(spark, sf):
    keys = F.json_object_keys("props")
    return load(spark, sf, "events").where(F.size(F.array_except(keys, F.array(F.lit("a"), F.lit("b")))) > 0).agg(F.count(F.lit(1)).alias("rows_with_unknown"))


@query("SELECT p_partkey, p_size + p_partkey % 7 AS total FROM part")
def comma_lists(spark, sf):
    t = load(spark, sf, "part").withColumn("s", F.concat(F.col("p_size").cast("string"), F.lit(", "), (F.col("p_partkey") % 7).cast("string")))
    return t.select("p_partkey", F.aggregate(comma_list(F.col("s")), F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id > 100 GROUP BY 1")
def event_stream_tail(spark, sf):
    return tail.replay(spark, f"{sf}/events.parquet", last=100)


@query("""WITH e AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events),
    k AS (SELECT *, max(event_id) FILTER (WHERE prior IS NULL OR value >= prior - 0.03::DOUBLE) OVER (PARTITION BY user_id) AS held FROM e)
    SELECT user_id, count(*) AS evals, round(max(value), 9) AS best, count(*) FILTER (WHERE event_id > held) AS streak FROM k GROUP BY 1""")
def event_stream_guard(spark, sf):
    return tail.replay_guard(spark, f"{sf}/events.parquet")
