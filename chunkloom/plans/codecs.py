"""Columnar text codecs as relational plans: differences, dictionaries, fixed decimals, ids and dates.

Row 0 of a column is stored verbatim and is the base of the differences when it is a canonical integer. Every
encoder has a decoder; the round trips are queries too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions.scalars import canonical_int, fixed_decimal, human_bytes, is_lower_hex, is_uuid, parse_size
from chunkloom.operators.ranges import previous
from chunkloom.plans.registry import query
from chunkloom.sources.catalog import load


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of epoch milliseconds per user, in event order."""
    e = load(spark, sf_dir, "events")
    return e.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("v"))


_EVENTS = "ev AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS v FROM events)"


def by_user() -> Window:
    return Window.partitionBy("user_id").orderBy("event_id")


@query("delta_encode", 80, sql=f"WITH {_EVENTS} SELECT event_id, user_id, v - lag(v, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM ev")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "user_id", (F.col("v") - F.lag("v", 1, 0).over(by_user())).alias("d"))


@query("delta_decode", 82, sql=f"WITH {_EVENTS} SELECT event_id, user_id, v FROM ev")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix sums of the differences: must give the column back."""
    back = F.sum("d").over(by_user().rowsBetween(Window.unboundedPreceding, 0))
    return delta_encode(spark, sf_dir).select("event_id", "user_id", back.alias("v"))


@query("delta2_encode", 81, sql=f"""
    WITH {_EVENTS}, d AS (SELECT event_id, user_id, v - lag(v, 1, 0) OVER w AS d FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, user_id, d - lag(d, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS d2 FROM d""")
def delta2_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_encode(spark, sf_dir).select("event_id", "user_id", (F.col("d") - F.lag("d", 1, 0).over(by_user())).alias("d2"))


@query("delta2_decode", 82, sql=f"WITH {_EVENTS} SELECT event_id, user_id, v FROM ev")
def delta2_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = by_user().rowsBetween(Window.unboundedPreceding, 0)
    once = delta2_encode(spark, sf_dir).select("event_id", "user_id", F.sum("d2").over(so_far).alias("d"))
    return once.select("event_id", "user_id", F.sum("d").over(so_far).alias("v"))


#: Fixed value: a dictionary holds no more values than two bytes tell apart.
MOST_VALUES = 65_536


@query("dict_encode", 83, 110, sql="""
    WITH f AS (SELECT p_type AS value, min(p_partkey) AS first_pos FROM part GROUP BY 1), i AS (SELECT value, row_number() OVER (ORDER BY first_pos) - 1 AS id FROM f)
    SELECT p_partkey AS pos, i.id FROM part JOIN i ON i.value = p_type""")
def dict_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids by first appearance; only the palette is ordered, not the column.

    A column with more than MOST_VALUES values is not for a dictionary: it gets no ids, and the one-task window over the
    palette never sees more rows than that.
    """
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("value"))
    palette = p.groupBy("value").agg(F.min("pos").alias("first_pos"))
    palette = palette if palette.limit(MOST_VALUES + 1).count() <= MOST_VALUES else palette.limit(0)
    ids = palette.select("value", (F.row_number().over(Window.orderBy("first_pos")) - 1).cast("long").alias("id"))
    return p.join(ids, "value").select("pos", "id")


@query("dict_palette", 110, sql="""
    WITH f AS (SELECT p_brand AS value, min(p_partkey) AS first_pos, count(*) AS n FROM part GROUP BY 1)
    SELECT row_number() OVER (ORDER BY first_pos) - 1 AS id, value, n, CASE WHEN count(*) OVER () = 1 THEN 0 WHEN count(*) OVER () <= 256 THEN 1 WHEN count(*) OVER () <= 65536 THEN 2 ELSE 3 END AS width FROM f""")
def dict_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("value")).agg(F.min("p_partkey").alias("first_pos"), F.count(F.lit(1)).alias("n"))
    f = f if f.limit(MOST_VALUES + 1).count() <= MOST_VALUES else f.limit(0)  # no dictionary, no palette
    kinds = F.count(F.lit(1)).over(Window.partitionBy())
    width = F.when(kinds == 1, 0).when(kinds <= 256, 1).when(kinds <= 65536, 2).otherwise(3)
    return f.select((F.row_number().over(Window.orderBy("first_pos")) - 1).cast("long").alias("id"), "value", "n", width.alias("width"))


@query("dict_card_gate", 72, sql="""
    WITH c AS (SELECT 'p_type' AS col, p_type AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part)
    SELECT col, count(*) AS n, count(DISTINCT v) AS kinds, count(DISTINCT v) < least((count(*) + 1) // 2, 65536) AS dictionary FROM c GROUP BY col""")
def dict_card_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_type", "p_brand", "p_name", F.col("p_partkey").cast("string").alias("p_partkey"))
    long = p.unpivot([], ["p_type", "p_brand", "p_name", "p_partkey"], "col", "v")
    out = long.groupBy("col", "v").agg(F.count(F.lit(1)).alias("m")).groupBy("col").agg(F.sum("m").alias("n"), F.count("v").alias("kinds"))
    return out.select("*", (F.col("kinds") < F.least(F.floor((F.col("n") + 1) / 2), F.lit(65536))).alias("dictionary"))


_PRICES = "p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)"


@query("decimal_delta_gate", 103, sql=f"""
    WITH {_PRICES}, d AS (SELECT l_orderkey, c, c - lag(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS d FROM p)
    SELECT l_orderkey, CAST(sum(abs(c)) AS BIGINT) AS total, CAST(coalesce(sum(abs(d)), 0) AS BIGINT) AS moved, coalesce(sum(abs(d)), 0) * 2 < sum(abs(c)) AS correlated FROM d GROUP BY 1""")
def decimal_delta_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed decimals are stored as differences only where neighbours are close: twice the moves below the total."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    d = load(spark, sf_dir, "lineitem").withColumn("c", cents).withColumn("d", F.col("c") - F.lag("c").over(w))
    out = d.groupBy("l_orderkey").agg(F.sum(F.abs("c")).alias("total"), F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("moved"))
    return out.select("*", (F.col("moved") * 2 < F.col("total")).alias("correlated"))


_TOKENS = "t AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '0' || event_id WHEN 2 THEN '-' || event_id WHEN 3 THEN '+' || event_id WHEN 4 THEN '-0' WHEN 5 THEN event_id || '.50' WHEN 6 THEN '99999999999999999999' ELSE 'x' || event_id END AS s FROM events)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("event_id") % 8, F.col("event_id").cast("string")
    shown = F.when(k == 0, s).when(k == 1, F.concat(F.lit("0"), s)).when(k == 2, F.concat(F.lit("-"), s)).when(k == 3, F.concat(F.lit("+"), s)).when(k == 4, "-0").when(k == 5, F.concat(s, F.lit(".50"))).when(k == 6, "99999999999999999999").otherwise(F.concat(F.lit("x"), s))
    return load(spark, sf_dir, "events").select("event_id", shown.alias("s"))


@query("canonical_int_gate", 101, sql=f"WITH {_TOKENS} SELECT event_id, s, CASE WHEN CAST(try_cast(s AS BIGINT) AS VARCHAR) = s AND strlen(s) <= 19 THEN try_cast(s AS BIGINT) END AS v FROM t")
def canonical_int_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("event_id", "s", canonical_int(F.col("s")).alias("v"))


@query("fixed_decimal_gate", 102, sql=f"""
    WITH {_TOKENS} SELECT event_id, CASE WHEN regexp_full_match(s, '-?(0|[1-9][0-9]*)\\.[0-9]+') AND strlen(s) BETWEEN 3 AND 19 THEN CAST(replace(s, '.', '') AS BIGINT) END AS scaled,
        CASE WHEN regexp_full_match(s, '-?(0|[1-9][0-9]*)\\.[0-9]+') AND strlen(s) BETWEEN 3 AND 19 THEN CAST(strlen(s) - strpos(s, '.') AS INTEGER) END AS scale FROM t""")
def fixed_decimal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled, scale = fixed_decimal(F.col("s"))
    return _tokens(spark, sf_dir).select("event_id", scaled.alias("scaled"), scale.alias("scale"))


@query("zpad_gate", 107, sql="""
    WITH z AS (SELECT p_partkey, lpad(CAST(p_partkey * 7 AS VARCHAR), 8, '0') AS s FROM part)
    SELECT p_partkey, s, CAST(s AS BIGINT) - lag(CAST(s AS BIGINT), 1, 0) OVER (PARTITION BY p_partkey % 16 ORDER BY p_partkey) AS d, lpad(CAST(CAST(s AS BIGINT) AS VARCHAR), 8, '0') = s AS exact FROM z""")
def zpad_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7).cast("string"), 8, "0").alias("s"))
    v = F.col("s").cast("long")
    p = previous(p.withColumn("lane", F.col("p_partkey") % 16), ["lane"], F.col("p_partkey"), v, "before")
    return p.select("p_partkey", "s", (v - F.coalesce("before", F.lit(0))).alias("d"), (F.lpad(v.cast("string"), 8, "0") == F.col("s")).alias("exact"))


@query("uuid_gate", 108, sql="""
    WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents), u AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(m) WHEN doc_id % 5 = 1 THEN m ELSE m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] END AS s FROM h)
    SELECT doc_id, CASE WHEN regexp_full_match(s, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') THEN replace(s, '-', '') END AS packed FROM u""")
def uuid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = F.md5(F.col("doc_id").cast("string")), F.col("doc_id") % 5
    dashed = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12))
    s = F.when(k == 0, F.upper(m)).when(k == 1, m).otherwise(dashed)
    return load(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.when(is_uuid(F.col("s")), F.lower(F.hex(F.unhex(F.replace("s", F.lit("-"), F.lit("")))))).alias("packed"))


@query("hex_gate", 105, sql="""
    WITH h AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN upper(md5(text)) WHEN doc_id % 4 = 1 THEN left(md5(text), 31) ELSE md5(text) END AS s FROM documents)
    SELECT doc_id, regexp_full_match(s, '([0-9a-f][0-9a-f])+') AS packable, CASE WHEN regexp_full_match(s, '([0-9a-f][0-9a-f])+') THEN strlen(s) // 2 END AS width FROM h""")
def hex_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = F.md5("text"), F.col("doc_id") % 4
    s = F.when(k == 0, F.upper(m)).when(k == 1, F.left(m, F.lit(31))).otherwise(m)
    d = load(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", is_lower_hex(F.col("s")).alias("packable"), F.when(is_lower_hex(F.col("s")), F.octet_length(F.unhex("s")).cast("long")).alias("width"))


@query("hex_delta", 106, sql="SELECT p_partkey, p_partkey * 11 - lag(p_partkey * 11, 1, 0) OVER (PARTITION BY p_partkey % 16 ORDER BY p_partkey) AS d FROM part")
def hex_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-digit hex counters as differences of their values."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.lpad(F.lower(F.hex(F.col("p_partkey") * 11)), 12, "0").alias("s"))
    v = F.conv("s", 16, 10).cast("long")
    p = previous(p.withColumn("lane", F.col("p_partkey") % 16), ["lane"], F.col("p_partkey"), v, "before")
    return p.select("p_partkey", (v - F.coalesce("before", F.lit(0))).alias("d"))


@query("iso_gate", 104, sql="""
    WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS s, CAST(epoch(o_orderdate) AS BIGINT) AS e, CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) AS day FROM orders)
    SELECT o_orderkey, s, CASE o_orderkey % 3 WHEN 0 THEN e WHEN 1 THEN day END AS epoch FROM s""")
def iso_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to epoch seconds where some layout gives the same text back."""
    t, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 3
    s = F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "dd.MM.yyyy"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))
    return o.select("o_orderkey", "s", iso_epoch(F.col("s")).alias("epoch"))


#: Layouts that round-trip at second precision or coarser.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def iso_epoch(s: Column) -> Column:
    tries = []
    for layout in LAYOUTS:
        t = F.try_to_timestamp(s, F.lit(layout))
        tries.append(F.when(F.date_format(t, layout) == s, F.unix_seconds(t)))
    return F.coalesce(*tries)


@query("base64_round_trip", 112, sql="SELECT doc_id, base64(encode(text)) AS b64, replace(replace(base64(encode(text)), '+', '-'), '/', '_') AS url FROM documents")
def base64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    return load(spark, sf_dir, "documents").select("doc_id", b.alias("b64"), F.translate(b, "+/", "-_").alias("url"))


@query("human_sizes", 113, sql="""
    SELECT o_orderkey, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN format('{:.1f} KiB', s / 1024.0) WHEN s < 1073741824 THEN format('{:.1f} MiB', s / 1048576.0) ELSE format('{:.1f} GiB', s / 1073741824.0) END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 4 AS s FROM orders)""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", human_bytes(F.col("o_orderkey") * F.col("o_orderkey") * 4).alias("shown"))


@query("parse_sizes", 113, 27, sql="""
    SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM part""")
def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, ("", "K", "m", "G"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", parse_size(F.concat(F.col("p_size").cast("string"), suffix)).alias("bytes"))


@query("base_names", 114, sql="""
    WITH u AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS p FROM pages)
    SELECT page_id, split_part(p, '/', -1) AS name, CASE WHEN p LIKE '%.html' THEN 'text/html' WHEN p LIKE '%.json' THEN 'application/json' ELSE 'application/octet-stream' END AS mime FROM u""")
def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    d = load(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    mime = F.when(F.endswith("p", F.lit(".html")), "text/html").when(F.endswith("p", F.lit(".json")), "application/json").otherwise("application/octet-stream")
    return d.select("page_id", F.element_at(F.split("p", "/", -1), -1).alias("name"), mime.alias("mime"))


@query("raw_column", 109, sql="SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || chr(10), '' ORDER BY l_linenumber, l_quantity) AS column FROM lineitem GROUP BY 1".replace("AS column", 'AS "column"'))
def raw_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("v"))))
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["v"].cast("string"), F.lit("\n"))), "").alias("column"))


@query("codec_choice_sql", 92, sql="""
    WITH c AS (SELECT l_orderkey, CAST(sum(strlen(CAST(l_partkey AS VARCHAR)) + 1) AS BIGINT) AS raw, CAST(count(DISTINCT l_partkey) * 6 + count(*) AS BIGINT) AS dict, CAST(count(*) * 4 AS BIGINT) AS delta FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN raw <= dict AND raw <= delta THEN 'raw' WHEN dict <= delta THEN 'dict' ELSE 'delta' END AS codec, least(raw, dict, delta) AS bytes FROM c""")
def codec_choice_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest of several estimates; the earlier codec wins ties."""
    size = F.octet_length(F.col("l_partkey").cast("string")) + 1
    c = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(size).alias("raw"), (F.countDistinct("l_partkey") * 6 + F.count(F.lit(1))).alias("dict"), (F.count(F.lit(1)) * 4).alias("delta"))
    best = F.array_min(F.array(*[F.struct(F.col(n).alias("bytes"), F.lit(i).alias("turn"), F.lit(n).alias("codec")) for i, n in enumerate(("raw", "dict", "delta"))]))
    return c.select("l_orderkey", best.alias("b")).select("l_orderkey", F.col("b.codec").alias("codec"), F.col("b.bytes").alias("bytes"))
