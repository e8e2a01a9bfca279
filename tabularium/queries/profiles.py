"""Scans, profiles and preparation."""

from pyspark.sql import functions as F

from tabularium.functions.hashing import feature_buckets, with_split
from tabularium.functions.numbers import integer_label, parse_number, parse_stream_number, power_floor
from tabularium.operators import prepare, profile
from tabularium.queries import SPLIT_SQL, load, mix_ctes, query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def is_num(v: str) -> str:
    return f"regexp_full_match({v}, {NUM}) AND isfinite(try_cast({v} AS DOUBLE))"


def cells_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, trim(coalesce(CAST({c} AS VARCHAR), '')) AS value FROM {table}" for c in columns)


def profile_sql(table: str, columns: list[str]) -> str:
    return f"""
        SELECT column_name, count(*) AS n_rows, count(*) FILTER (value = '') AS n_blank, count(*) FILTER ({is_num('value')}) AS n_numeric,
               count(DISTINCT CASE WHEN value <> '' THEN value END) AS n_distinct
        FROM ({cells_sql(table, columns)}) GROUP BY column_name"""


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def scan_counts(spark, sf):
    out = None
    for t in TABLES:
        one = load(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(f"""SELECT column_name, n_rows, n_blank, n_numeric, round(CASE WHEN n_rows > n_blank THEN n_numeric::DOUBLE / (n_rows - n_blank) ELSE 0 END, 9) AS ratio,
    n_rows > n_blank AND n_numeric::DOUBLE / (n_rows - n_blank) >= 0.95 AS is_numeric FROM ({profile_sql('orders', ORDER_COLUMNS)})""")
def numeric_ratio(spark, sf):
    p = profile.column_profile(load(spark, sf, "orders").select(*ORDER_COLUMNS))
    return p.select("column_name", "n_rows", "n_blank", "n_numeric", F.round("ratio", 9).alias("ratio"), "is_numeric")


@query(f"SELECT column_name, n_rows, n_blank, n_blank > 0 AS nullable FROM ({profile_sql('conversations', ['conv_id', 'turn', 'role', 'text'])})")
def missing_profile(spark, sf):
    return profile.column_profile(load(spark, sf, "conversations")).select("column_name", "n_rows", "n_blank", "nullable")


ITEM_COLUMNS = ["l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_partkey"]


@query(f"""SELECT column_name, n_distinct, n_rows > n_blank AND n_numeric::DOUBLE / (n_rows - n_blank) >= 0.95 AS is_numeric,
    n_distinct BETWEEN 2 AND 64 OR (n_distinct > 2 AND n_rows > n_blank AND n_numeric::DOUBLE / (n_rows - n_blank) >= 0.95) AS candidate
    FROM ({profile_sql('lineitem', ITEM_COLUMNS)})""")
def target_candidates(spark, sf):
    return profile.target_candidates(profile.column_profile(load(spark, sf, "lineitem").select(*ITEM_COLUMNS)))


TASKS = [("lineitem", "l_returnflag"), ("lineitem", "l_quantity"), ("lineitem", "l_tax"), ("lineitem", "l_linenumber"), ("lineitem", "l_extendedprice"), ("labels", "quality"), ("orders", "o_orderstatus"), ("documents", "source"), ("documents", "lang")]


def task_sql(stream: bool) -> str:
    limit = "greatest(20, floor(sqrt(n))::BIGINT + 1)"
    limit = f"least(64, {limit})" if stream else limit
    rule = f"""CASE WHEN k = 2 THEN 'binary_classification' WHEN nn < n THEN CASE WHEN k > 64 THEN 'error' ELSE 'multiclass_classification' END
               WHEN nw = n AND k <= {limit} THEN 'multiclass_classification' ELSE 'regression' END""" if stream else f"""
               CASE WHEN nn = n AND k = 2 THEN 'binary_classification' WHEN nn = n AND nw = n AND k > 2 AND k <= {limit} THEN 'multiclass_classification'
               WHEN nn = n THEN 'regression' WHEN k < 2 OR k > 64 THEN 'error' WHEN k = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END"""
    one = lambda t, c: f"""SELECT '{c}' AS target, count(*) AS n, count(DISTINCT coalesce(CAST(x AS VARCHAR), v)) AS k, count(x) AS nn, count(*) FILTER (x = floor(x)) AS nw
        FROM (SELECT v, CASE WHEN {is_num('v')} THEN try_cast(v AS DOUBLE) END AS x FROM (SELECT trim(coalesce(CAST({c} AS VARCHAR), '')) AS v FROM {t}) WHERE v <> '')"""  # noqa: E731
    return f"SELECT target, n AS n_rows, k AS n_classes, {rule} AS task FROM ({' UNION ALL '.join(one(t, c) for t, c in TASKS)})"


def _tasks(spark, sf, stream):
    out = None
    for t, c in TASKS:
        one = profile.target_task(load(spark, sf, t), c, stream)
        out = one if out is None else out.unionByName(one)
    return out


@query(task_sql(False))
def task_inference(spark, sf):
    return _tasks(spark, sf, False)


@query(task_sql(True))
def task_inference_stream(spark, sf):
    return _tasks(spark, sf, True)


@query("SELECT l_returnflag AS label, (row_number() OVER (ORDER BY l_returnflag) - 1)::INTEGER AS class_id, count(*) AS n FROM lineitem GROUP BY 1")
def class_index(spark, sf):
    return profile.class_index(load(spark, sf, "lineitem"), "l_returnflag")


@query("SELECT CAST(l_linenumber AS VARCHAR) AS label, (row_number() OVER (ORDER BY l_linenumber) - 1)::INTEGER AS class_id, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def class_index_numeric(spark, sf):
    return profile.class_index(load(spark, sf, "lineitem"), "l_linenumber", numeric=True)


@query("SELECT * FROM (VALUES ('copy', 'leak'), ('blank', 'empty'), ('one', 'constant'), ('word', 'constant')) AS t(column_name, reason)")
def dropped_columns(spark, sf):
    t = load(spark, sf, "part").select("p_size", "p_retailprice", "p_brand", F.col("p_size").alias("copy"), F.lit("  ").alias("blank"), F.lit(1.5).alias("one"), F.lit("x").alias("word"))
    return profile.dropped_columns(t, "p_size")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS c FROM documents), m AS (SELECT median(c) AS med FROM d),
    i AS (SELECT doc_id, coalesce(c, med)::DOUBLE AS v FROM d, m), s AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM i)
    SELECT doc_id, round((v - mu) / sd, 6) AS z FROM i, s""")
def median_impute(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("c"))
    s = prepare.numeric_stats(d, ["c"]).first()
    return d.select("doc_id", F.round((F.coalesce(parse_number(F.col("c")), F.lit(s["median"])) - s["mean"]) / s["std"], 6).alias("z"))


STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 6) AS median, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in STATS))
def standardize_stats(spark, sf):
    s = prepare.numeric_stats(load(spark, sf, "lineitem"), STATS)
    return s.select("feature", *(F.round(c, 6).alias(c) for c in ("median", "mean", "std")))


@query("""WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_discount) AS c, stddev_pop(l_discount) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - a) / b, 6) AS z_quantity, round((l_discount - c) / d, 6) AS z_discount FROM lineitem, s""")
def standardize_rows(spark, sf):
    t = load(spark, sf, "lineitem")
    s = {r.feature: r for r in prepare.numeric_stats(t, ["l_quantity", "l_discount"]).collect()}
    z = lambda c: F.round((F.col(c) - s[c]["mean"]) / s[c]["std"], 6)
    return t.select("l_orderkey", "l_linenumber", z("l_quantity").alias("z_quantity"), z("l_discount").alias("z_discount"))


@query(f"WITH {mix_ctes('lineitem', 'l_orderkey')}, t AS (SELECT * FROM mixed WHERE {SPLIT_SQL} = 'train') " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM t" for c in STATS))
def train_only_stats(spark, sf):
    t = with_split(load(spark, sf, "lineitem"), F.col("l_orderkey")).where("split = 'train'")
    s = prepare.numeric_stats(t, STATS, impute=False)
    return s.crossJoin(t.agg(F.count(F.lit(1)).alias("n"))).select("feature", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("WITH c AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS cats FROM orders) SELECT o_orderkey, array_to_string(list_transform(cats, lambda k: CASE WHEN k = o_orderpriority THEN '1' ELSE '0' END), '') AS encoded FROM orders, c")
def one_hot_rows(spark, sf):
    t = load(spark, sf, "orders")
    cats = sorted(r[0] for r in t.select("o_orderpriority").distinct().collect())
    return t.select("o_orderkey", F.array_join(F.transform(prepare.one_hot(F.col("o_orderpriority"), cats), lambda x: x.cast("int").cast("string")), "").alias("encoded"))


@query("SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1")
def one_hot_counts(spark, sf):
    t = load(spark, sf, "orders")
    cats = sorted(r[0] for r in t.select("o_orderpriority").distinct().collect())
    sums = t.select(F.posexplode(prepare.one_hot(F.col("o_orderpriority"), cats)).alias("k", "x")).groupBy("k").agg(F.sum("x").cast("long").alias("n"))
    return sums.select(F.get(F.array(*map(F.lit, cats)), F.col("k")).alias("category"), "n")


@query("""SELECT l_returnflag AS value, b.bucket::BIGINT AS bucket, count(*) AS n FROM lineitem JOIN (VALUES ('N', 18), ('R', 63), ('A', 26)) AS b(v, bucket) ON l_returnflag = v GROUP BY 1, 2""")
def feature_hash(spark, sf):
    t = load(spark, sf, "lineitem")
    return t.join(feature_buckets(t, "l_returnflag"), F.col("l_returnflag") == F.col("value")).groupBy("value", "bucket").agg(F.count(F.lit(1)).alias("n"))


CELLS = ["1", " 2.5 ", "1e3", "", "nan", "inf", "1,5", "1_0", "1d", "True", "-.5", "+7.", "0x10", "1e400"]


@query("SELECT * FROM (VALUES ('1', 1.0::DOUBLE, 1.0::DOUBLE, '1'), ('2.5', 2.5, 2.5, '2.5'), ('1e3', 1000, 1000, '1000'), ('', NULL, NULL, NULL), ('nan', NULL, NULL, NULL), ('inf', NULL, NULL, NULL), ('1,5', NULL, 1.5, NULL), ('1_0', NULL, NULL, NULL), ('1d', NULL, NULL, NULL), ('True', NULL, NULL, NULL), ('-.5', -0.5, -0.5, '-0.5'), ('+7.', 7, 7, '7'), ('0x10', NULL, NULL, NULL), ('1e400', NULL, NULL, NULL)) AS t(cell, number, stream_number, label)")
def number_parse(spark, sf):
    t = spark.createDataFrame([(c,) for c in CELLS], "c string")
    return t.select(F.trim("c").alias("cell"), parse_number(F.col("c")).alias("number"), parse_stream_number(F.col("c")).alias("stream_number"), integer_label(parse_number(F.col("c"))).alias("label"))


@query("SELECT p_size AS size, (CASE WHEN p_size < 2 THEN 2 ELSE pow(2, floor(log2(p_size))) END)::BIGINT AS power, count(*) AS n FROM part GROUP BY 1, 2")
def power_of_two(spark, sf):
    t = load(spark, sf, "part")
    return t.select(F.col("p_size").alias("size"), power_floor(F.col("p_size")).alias("power")).groupBy("size", "power").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT median(o_totalprice) AS m, avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM orders),
    c AS (SELECT list_sort(list(DISTINCT o_orderpriority)) AS cats FROM orders), k AS (SELECT list_sort(list(DISTINCT o_orderstatus)) AS cl FROM orders)
    SELECT o_orderkey, (list_position(cl, o_orderstatus) - 1)::DOUBLE AS label, round((o_totalprice - mu) / sd, 6) AS f0, (list_position(cats, o_orderpriority) + 1)::INTEGER AS hot FROM orders, s, c, k""")
def fitted_encoder(spark, sf):
    t = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    enc = prepare.fit_encoder(t.drop("o_orderkey"), "o_orderstatus")
    return enc.transform(t, ("o_orderkey",)).select("o_orderkey", "label", F.round(F.get("features", F.lit(0)), 6).alias("f0"), F.array_position("features", F.lit(1.0)).cast("int").alias("hot"))


@query(f"""WITH {mix_ctes('lineitem', 'l_orderkey')}, s AS (SELECT *, {SPLIT_SQL} AS split FROM mixed)
    SELECT count(*) AS rows, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test,
    round(avg(l_quantity) FILTER (split = 'train'), 6) AS mean_quantity, round(stddev_pop(l_tax) FILTER (split = 'train'), 6) AS std_tax,
    array_to_string(list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR))), ',') AS targets, false AS overflow FROM s""")
def numeric_scan(spark, sf):
    t = with_split(load(spark, sf, "lineitem"), F.col("l_orderkey")).select("l_quantity", "l_tax", "l_linenumber", "split")
    r = profile.numeric_scan(t, "l_linenumber")
    return r.select("rows", "train", "validation", "test", F.round(F.col("means")["l_quantity"], 6).alias("mean_quantity"), F.round(F.col("stds")["l_tax"], 6).alias("std_tax"), F.array_join("targets", ",").alias("targets"), "overflow")
