"""Scalar functions: strings, dates, mathematics, conditions, arrays, maps, structs, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.vectors import cosine, distance
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(
    "strings",
    """
    SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, substring(c_name, 1, 4) AS head, length(c_name)::BIGINT AS n,
           replace(c_name, '#', '-') AS dashed, lpad(c_custkey::VARCHAR, 8, '0') AS padded, c_name || ':' || c_mktsegment AS both_parts,
           strpos(c_name, '#')::BIGINT AS at, reverse(c_mktsegment) AS back, regexp_extract(c_name, '[0-9]+') AS digits,
           md5(c_name) AS digest, split_part(c_name, '#', 2) AS tail, trim('  x ') AS bare, c_name LIKE '%1%' AS has_one
    FROM customer""",
)
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(name).alias("up"), F.lower(segment).alias("low"), F.substring(name, 1, 4).alias("head"), F.length(name).cast("long").alias("n"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("dashed"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), F.concat(name, F.lit(":"), segment).alias("both_parts"),
        F.instr(name, "#").cast("long").alias("at"), F.reverse(segment).alias("back"), F.regexp_extract(name, "[0-9]+", 0).alias("digits"),
        F.md5(name).alias("digest"), F.split_part(name, F.lit("#"), F.lit(2)).alias("tail"), F.trim(F.lit("  x ")).alias("bare"), name.like("%1%").alias("has_one"),
    )


@query(
    "dates",
    """
    SELECT o_orderkey, extract(year FROM o_orderdate)::BIGINT AS y, extract(quarter FROM o_orderdate)::BIGINT AS q, extract(doy FROM o_orderdate)::BIGINT AS doy,
           dayofweek(o_orderdate)::BIGINT AS dow, date_trunc('month', o_orderdate)::TIMESTAMP AS month, (o_orderdate + INTERVAL 40 DAY)::TIMESTAMP AS later,
           last_day(o_orderdate)::DATE AS month_end, date_diff('day', o_orderdate, TIMESTAMP '2002-01-01')::BIGINT AS days_left,
           strftime(o_orderdate, '%Y/%m') AS label, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS next_month
    FROM orders""",
)
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    long = lambda c: c.cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", long(F.year(d)).alias("y"), long(F.quarter(d)).alias("q"), long(F.dayofyear(d)).alias("doy"), long(F.dayofweek(d) - 1).alias("dow"),
        F.date_trunc("month", d).cast("timestamp_ntz").alias("month"), (d + F.expr("INTERVAL 40 DAYS")).alias("later"), F.last_day(d).alias("month_end"),
        long(F.date_diff(F.lit("2002-01-01").cast("date"), d)).alias("days_left"), F.date_format(d, "yyyy/MM").alias("label"), F.add_months(d, 1).alias("next_month"),
    )


@query(
    "mathematics",
    """
    SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, floor(p_retailprice)::BIGINT AS down, ceil(p_retailprice)::BIGINT AS up,
           abs(p_size - 25)::BIGINT AS off, p_size % 7 AS rest, round(power(p_size, 1.5), 4) AS pow, sign(p_size - 25)::BIGINT AS side,
           greatest(p_size, 10) AS at_least, least(p_size, 40) AS at_most, round(sin(p_size), 8) AS s, p_size & 12 AS masked, p_size << 2 AS shifted
    FROM part""",
)
def mathematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.sqrt(price), 6).alias("root"), F.round(F.ln(price), 6).alias("log"), F.floor(price).alias("down"), F.ceil(price).alias("up"),
        F.abs(size - 25).cast("long").alias("off"), (size % 7).alias("rest"), F.round(F.pow(size, 1.5), 4).alias("pow"), F.sign(size - 25).cast("long").alias("side"),
        F.greatest(size, F.lit(10)).alias("at_least"), F.least(size, F.lit(40)).alias("at_most"), F.round(F.sin(size), 8).alias("s"), size.bitwiseAND(12).alias("masked"), F.shiftleft(size, 2).alias("shifted"),
    )


@query(
    "conditions",
    """
    SELECT l_orderkey, l_partkey, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS band,
           nullif(l_returnflag, 'N') AS flag, coalesce(nullif(l_returnflag, 'N'), 'none') AS named, l_linestatus IN ('O', 'X') AS open,
           round(l_extendedprice / nullif(l_tax, 0), 4) AS ratio
    FROM lineitem""",
)
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, flag = F.col("l_quantity"), F.nullif(F.col("l_returnflag"), F.lit("N"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(q < 10, "small").when(q < 30, "middle").otherwise("large").alias("band"), flag.alias("flag"), F.coalesce(flag, F.lit("none")).alias("named"),
        F.col("l_linestatus").isin("O", "X").alias("open"), F.round(F.col("l_extendedprice") / F.nullif(F.col("l_tax"), F.lit(0.0)), 4).alias("ratio"),
    )


@query(
    "arrays",
    """
    SELECT o_custkey, list_sort(list(o_orderkey)) AS keys, len(list(o_orderkey))::BIGINT AS n, list_contains(list(o_orderkey), 7) AS has_7,
           list_sum(list_transform(list(o_orderkey), lambda x: x * 2))::BIGINT AS doubled, len(list_filter(list(o_totalprice), lambda x: x > 200000))::BIGINT AS dear,
           list_sort(list_distinct(list(o_orderstatus))) AS states
    FROM orders GROUP BY o_custkey""",
)
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k"), F.collect_list("o_totalprice").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    return per.select(
        "o_custkey", F.array_sort("k").alias("keys"), F.size("k").cast("long").alias("n"), F.array_contains("k", 7).alias("has_7"),
        F.aggregate(F.transform("k", lambda x: x * 2), F.lit(0).cast("long"), lambda a, x: a + x).alias("doubled"), F.size(F.filter("p", lambda x: x > 200000)).cast("long").alias("dear"), F.array_sort("s").alias("states"),
    )


@query("unnest", "SELECT event_type, piece, count(*) AS n FROM (SELECT event_type, unnest(string_split(event_type, 'e')) AS piece FROM events) GROUP BY event_type, piece")
def unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.explode(F.split("event_type", "e")).alias("piece")).groupBy("event_type", "piece").agg(F.count(F.lit(1)).alias("n"))


@query(
    "json",
    """
    SELECT event_id, (props ->> '$.k')::BIGINT AS k, (props ->> '$.missing') IS NULL AS absent, json_extract_string('{"a":[1,{"b":"x"}]}', '$.a[1].b') AS nested FROM events""",
)
def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k long, missing string")
    nested = F.get_json_object(F.lit('{"a":[1,{"b":"x"}]}'), "$.a[1].b")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["missing"].isNull().alias("absent"), nested.alias("nested"))


@query("variant_json", "SELECT user_id, sum((props ->> '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY user_id")
def variant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.variant_get(F.parse_json("props"), "$.k", "long")).alias("total"))


@query(
    "vectors",
    """
    WITH c AS (SELECT label, embedding AS e FROM embeddings WHERE vec_id = 7)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS cos, round(list_distance(embedding::DOUBLE[], e::DOUBLE[]), 6) AS dist
    FROM embeddings, c WHERE embeddings.label = c.label""",
)
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    one = rows.where("vec_id = 7").select(F.col("label").alias("l"), F.col("embedding").alias("e"))
    met = rows.join(one, F.col("label") == F.col("l"))
    return met.select("vec_id", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("cos"), F.round(distance(F.col("embedding"), F.col("e")), 6).alias("dist"))


@query("maps", "SELECT event_type, count(DISTINCT user_id % 10)::BIGINT AS keys, sum(DISTINCT user_id % 10)::BIGINT AS total FROM events GROUP BY event_type")
def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("d")).distinct()
    per = digit.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("string").alias("k"), "d"))).alias("m"))
    return per.select("event_type", F.size(F.map_keys("m")).cast("long").alias("keys"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
