"""Queries over the driver's tables for the relational operators and column functions, each with its SQL.

A customer's orders, by key, stand for the pages of a document; events stand for cues; documents for files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(own).alias("page"))


PAGES = "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS page FROM orders"


@query(f"SELECT o_custkey, o_orderkey, ntile(3) OVER (PARTITION BY o_custkey ORDER BY page)::INT AS part FROM ({PAGES})")
def even_split(spark, sf_dir):
    return R.even_split(pages_of(spark, sf_dir), "o_custkey", "page", 3).select("o_custkey", "o_orderkey", "part")


@query(f"""
WITH RECURSIVE p AS ({PAGES}), s AS (
  SELECT o_custkey, o_orderkey, page, 1 AS part, o_totalprice AS total FROM p WHERE page = 1
  UNION ALL SELECT p.o_custkey, p.o_orderkey, p.page, CASE WHEN total + o_totalprice <= 300000 THEN part ELSE part + 1 END, CASE WHEN total + o_totalprice <= 300000 THEN total + o_totalprice ELSE o_totalprice END
  FROM s JOIN p ON p.o_custkey = s.o_custkey AND p.page = s.page + 1)
SELECT o_custkey, page, part FROM s""")
def split_by_size(spark, sf_dir):
    return R.split_by_size(pages_of(spark, sf_dir), "o_custkey", "page", "o_totalprice", 300_000)


@query(f"""
WITH p AS ({PAGES}), t AS (SELECT o_custkey, max(page) AS n FROM p GROUP BY 1),
s AS (SELECT o_custkey, unnest(list_concat([3, 2, 1], generate_series(2, n))) AS page, unnest(generate_series(0, n + 1)) AS pos FROM t WHERE n >= 3)
SELECT s.o_custkey, s.pos::INT AS pos, s.page::INT AS page, p.o_orderkey FROM s JOIN p ON p.o_custkey = s.o_custkey AND p.page = s.page""")
def page_extract(spark, sf_dir):
    return R.select_pages(pages_of(spark, sf_dir), "o_custkey", "page", F.lit("3-1,2-")).select("o_custkey", "pos", "page", "o_orderkey")


@query(f"SELECT o_custkey, max(page)::BIGINT AS total FROM ({PAGES}) GROUP BY 1 HAVING max(page) < 12")
def page_spec_errors(spark, sf_dir):
    return R.spec_errors(pages_of(spark, sf_dir), "o_custkey", "page", F.lit("1, 12"))


@query(f"""
WITH p AS ({PAGES}), t AS (SELECT o_custkey, max(page) AS n FROM p GROUP BY 1)
SELECT p.o_custkey, p.o_orderkey, p.page FROM p JOIN t USING (o_custkey) WHERE n < 4 OR page NOT IN (1, 3, 4)""")
def page_remove(spark, sf_dir):
    return R.remove_pages(pages_of(spark, sf_dir), "o_custkey", "page", F.lit("1;3-4")).select("o_custkey", "o_orderkey", "page")


@query(f"""
WITH p AS ({PAGES}), t AS (SELECT o_custkey, max(page) AS n FROM p GROUP BY 1),
b AS (SELECT o_custkey, page::DOUBLE AS o, page AS old FROM p UNION ALL SELECT o_custkey, a + 0.5, NULL FROM t, (VALUES (0), (2)) v(a) WHERE a <= n)
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o)::INT AS new, old::INT AS old FROM b""")
def page_insert(spark, sf_dir):
    return R.insert_blanks(pages_of(spark, sf_dir), "o_custkey", "page", [0, 2])


@query(f"SELECT o_custkey, o_orderkey, page, CASE WHEN page IN (1, 2) THEN 90 ELSE 0 END AS rotation FROM ({PAGES})")
def page_rotate(spark, sf_dir):
    pages = pages_of(spark, sf_dir)
    turned = F.when(F.array_contains(F.lit([1, 2]), F.col("page")), F.pmod(F.lit(-270), F.lit(360))).otherwise(0)
    return pages.select("o_custkey", "o_orderkey", "page", turned.alias("rotation"))


@query("""
SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, o_orderkey)::INT AS merged
FROM orders JOIN customer ON o_custkey = c_custkey""")
def merge_pages(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("c_nationkey", "c_custkey", "o_orderkey")
    return R.merge_in_order(joined, "c_nationkey", "c_custkey", "o_orderkey").select("c_nationkey", "o_orderkey", "merged")


@query(f"""
WITH p AS ({PAGES}), t AS (SELECT o_custkey, max(page) AS n FROM p GROUP BY 1),
b AS (SELECT o_custkey, page - 1 AS page, o_orderkey::VARCHAR AS title FROM p WHERE o_orderkey % 3 = 0),
r AS (SELECT b.o_custkey, title, page AS first, coalesce(lead(page) OVER (PARTITION BY b.o_custkey ORDER BY page) - 1, n - 1) AS last FROM b JOIN t USING (o_custkey))
SELECT o_custkey, title, first::INT AS first, last::INT AS last FROM r
UNION ALL SELECT o_custkey, NULL, 0, (min(page) - 1)::INT FROM b GROUP BY 1 HAVING min(page) > 0""")
def outline_ranges(spark, sf_dir):
    pages = pages_of(spark, sf_dir).withColumn("total", F.count("*").over(Window.partitionBy("o_custkey")).cast("int"))
    marks = pages.where("o_orderkey % 3 = 0").select("o_custkey", (F.col("page") - 1).alias("page"), F.col("o_orderkey").cast("string").alias("title"), "total")
    return R.outline_ranges(marks, "o_custkey", "page", "title", "total")


@query("""
SELECT kind, id, added FROM (
  SELECT 'event' AS kind, event_id AS id, ts AS added FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders)
ORDER BY added DESC, kind, id LIMIT 800""")
def newest_union(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("added"))
    orders = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("added"))
    return R.newest([events, orders], "added", ["kind", "id"], 800)


@query("""
SELECT l_orderkey, CASE WHEN min(nullif(l_suppkey % 3, 0)) = max(nullif(l_suppkey % 3, 0)) THEN min(nullif(l_suppkey % 3, 0)) END AS group_id
FROM lineitem GROUP BY 1""")
def batch_inherit(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("g"))
    return R.inherit_batch(links, "l_orderkey", "g")


@query("""
SELECT o_custkey, o_orderkey, name || '.csv' AS name, name || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.csv' AS unique_name
FROM (SELECT o_custkey, o_orderkey, o_orderstatus AS name, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)""")
def unique_names(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.col("o_orderstatus"), F.lit(".csv")).alias("name"))
    return R.unique_names(files, "o_custkey", "o_orderkey", "name")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_duplicate(spark, sf_dir):
    return R.keep_last(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("""
SELECT o_custkey, o_orderkey, (year(o_orderdate) * 100 + month(o_orderdate) * 10 - day(o_orderdate))::INT AS score FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) = 1""")
def best_candidate(spark, sf_dir):
    score = F.year("o_orderdate") * 100 + F.month("o_orderdate") * 10 - F.dayofmonth("o_orderdate")
    return R.best_by(table(spark, sf_dir, "orders"), "o_custkey", score, "o_orderkey", ["o_orderkey"])


@query("""
WITH s AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_linenumber AS mode, w AS weight FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_linenumber) = 1""")
def weighted_mode(spark, sf_dir):
    return R.weighted_mode(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity")


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey, v[len(v) // 2 + 1] AS upper_median, (v[len(v) // 2 + 1] + v[(len(v) - 1) // 2 + 1]) / 2 AS mean_median FROM s""")
def medians(spark, sf_dir):
    return R.medians(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")


@query("""
WITH f AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM f""")
def gap_islands(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    begins = F.col("ts") - R.previous("ts", "user_id", "o") > F.expr("INTERVAL 6 HOURS")
    return R.islands(events.withColumn("late", begins), "user_id", "o", F.col("late")).select("user_id", "event_id", "island")


INTERVALS = "SELECT user_id AS u, event_id AS cue, ts AS s, ts + CASE WHEN event_type = 'signup' THEN INTERVAL 90 DAY ELSE INTERVAL 3 HOUR END AS e, event_type AS t FROM events WHERE event_type <> 'view'"


@query(f"""
SELECT event_id, p.user_id, p.ts, (SELECT max_by(i.t, i.cue) FROM ({INTERVALS}) i WHERE i.u = p.user_id AND p.ts >= i.s AND p.ts < i.e) AS t
FROM events p, range(2) WHERE event_type = 'view'""")
def interval_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cues = events.where("event_type <> 'view'").select("user_id", F.col("event_id").alias("cue"), F.col("ts").alias("s"), F.when(F.col("event_type") == "signup", F.col("ts") + F.expr("INTERVAL 90 DAYS")).otherwise(F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("e"), F.col("event_type").alias("t"))
    points = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    points = points.unionByName(points)  # repeated points stay repeated
    return R.interval_lookup(points, cues, "user_id", "ts", "s", "e", "cue", "t")


@query("""
WITH c AS (SELECT user_id, ts, event_id, (epoch_us(ts) // 1000000)::BIGINT AS s, ((epoch_ms(ts) // 1000) + (value * 100)::BIGINT % 7000 - 100)::BIGINT AS e FROM events),
f AS (SELECT user_id, e < s AS r, e = s AS z, s < lag(e) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM c)
SELECT user_id, count(*) FILTER (r) AS reversed, count(*) FILTER (z) AS empty, count(*) FILTER (o) AS overlapping FROM f GROUP BY 1""")
def overlap_counts(spark, sf_dir):
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    cues = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), start.alias("s"), (start + F.rint(F.col("value") * 100).cast("long") % 7000 - 100).alias("e"))
    return R.timeline_problems(cues, "user_id", "o", "s", "e")


@query("""
WITH c AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS start_ms, CASE WHEN event_id % 2 = 0 THEN event_id % 5000 END AS d FROM events)
SELECT user_id, event_id, start_ms, greatest(coalesce(start_ms + d, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id), start_ms + 2000), start_ms + 1) AS end_ms FROM c""")
def cue_ends(spark, sf_dir):
    cues = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5000).alias("d"))
    return R.cue_ends(cues, "user_id", "start_ms", "d", ["event_id"]).drop("d")


@query("""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY 1),
k AS (SELECT source, regexp_replace(line, '[0-9]', '#', 'g') AS key, count(DISTINCT doc_id) AS on_pages FROM l GROUP BY 1, 2)
SELECT k.source, key, on_pages FROM k JOIN n USING (source) WHERE on_pages >= greatest(3, ceil(pages * 0.05))""")
def running_heads(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return R.repeated_lines(lines, "source", "doc_id", F.regexp_replace("line", "[0-9]", "#"), 3, 0.05)


@query("""
SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, '' AS r_regionkey, '' AS r_name FROM nation
UNION ALL SELECT '', '', '', r_regionkey::VARCHAR, r_name FROM region""")
def column_union(spark, sf_dir):
    return R.union_columns([table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")])


@query("""
SELECT coalesce(s_nationkey, c_nationkey) AS nation, count(*) FILTER (s_suppkey IS NOT NULL AND c_custkey IS NOT NULL) AS found, count(*) FILTER (c_custkey IS NULL) AS unknown, count(*) FILTER (s_suppkey IS NULL) AS unused
FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey GROUP BY 1""")
def spine_join(spark, sf_dir):
    spine = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return R.key_join_counts(spine, table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), "nation", "s_suppkey", "c_custkey")


@query("""
SELECT l_orderkey, l_linenumber, t AS p_type FROM lineitem JOIN part ON l_partkey = p_partkey
LEFT JOIN (SELECT p_brand AS b, max_by(p_type, p_partkey) AS t FROM part WHERE p_size > 25 GROUP BY 1) ON b = p_brand""")
def name_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == part["p_partkey"]).select("l_orderkey", "l_linenumber", "p_brand")
    return R.lookup_by_name(rows, part.where("p_size > 25"), "p_brand", "p_partkey", "p_type").drop("p_brand")


@query("""
WITH k AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders), c(o_orderstatus, operation) AS (VALUES ('F', 'a'), ('O', 'a'), ('F', 'b'), ('P', 'b'), ('O', 'c')),
n AS (SELECT o_custkey, count(*) AS n FROM k GROUP BY 1)
SELECT o_custkey, operation FROM k JOIN c USING (o_orderstatus) JOIN n USING (o_custkey) GROUP BY o_custkey, operation, n HAVING count(*) = n""")
def eligible_operations(spark, sf_dir):
    compatibility = spark.createDataFrame([("F", "a"), ("O", "a"), ("F", "b"), ("P", "b"), ("O", "c")], "o_orderstatus string, operation string")
    return R.every_kind(table(spark, sf_dir, "orders"), compatibility, "o_custkey", "o_orderstatus", "operation")


@query("""
WITH e AS (SELECT l_orderkey, (l_extendedprice * 1000)::BIGINT AS size, l_linenumber = 1 AS d, CASE WHEN l_returnflag = 'R' THEN 'password' END AS w FROM lineitem),
f AS (SELECT l_orderkey, size, d, CASE WHEN size > 67108864 THEN 'entry_too_large' ELSE w END AS w FROM e),
s AS (SELECT l_orderkey, count(*) FILTER (NOT d) AS files, coalesce(sum(size) FILTER (NOT d), 0)::BIGINT AS bytes, count(*) FILTER (NOT d AND w IS NULL) AS kept, count(*) FILTER (NOT d AND w IS NOT NULL) AS skipped FROM f GROUP BY 1)
SELECT *, CASE WHEN files = 0 THEN 'only_directories' WHEN bytes > 536870912 THEN 'too_large' WHEN kept = 0 THEN 'nothing_usable' END AS refused FROM s""")
def archive_plan(spark, sf_dir):
    entries = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.round(F.col("l_extendedprice") * 1000).cast("long").alias("size"), (F.col("l_linenumber") == 1).alias("is_dir"), F.when(F.col("l_returnflag") == "R", "password").alias("skip_reason")
    )
    return R.archive_plan(entries, "l_orderkey")


# -- columns ------------------------------------------------------------------------------------------------------------


@query("""
SELECT event_id, '"' || replace(props, '"', '""') || '",' || event_type || ',' || (props->>'$.k') || chr(10) AS csv_line FROM events""")
def json_to_csv(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", C.csv_row([F.col("props"), F.col("event_type"), F.get_json_object("props", "$.k")]).alias("csv_line"))


@query("SELECT c_custkey, '\"' || c_custkey || '\";\"' || c_name || '\";\"' || c_mktsegment || '\"' || chr(13) || chr(10) AS line FROM customer")
def csv_quote_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.csv_row([F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")], ";", "\r\n", True).alias("line"))


@query("""
SELECT doc_id, CASE WHEN text LIKE '%|%' OR text LIKE '%"%' OR text LIKE '%' || chr(10) || '%' OR text LIKE '%' || chr(13) || '%' THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM documents""")
def csv_cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.csv_cell(F.col("text"), "|").alias("cell"))


@query("SELECT p_partkey, '<row><name>' || p_name || '</name><size>' || p_size || '</size></row>' AS xml FROM part")
def rows_to_xml(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.xml_row("row", {"name": F.col("p_name"), "size": F.col("p_size")}).alias("xml"))


@query("""
SELECT page_id, '<tr><td>' || page_id || '</td><td>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>' AS row FROM pages""")
def rows_to_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.html_row([F.col("page_id"), F.col("url")]).alias("row"))


@query("SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS row FROM nation")
def rows_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", C.markdown_row([F.col("n_nationkey"), F.col("n_name")]).alias("row"))


@query("""
SELECT doc_id, (len(text) - len(replace(text, chr(10), '')))::INT AS lf, 0 AS crlf, 0 AS cr, CASE WHEN text LIKE '%' || chr(10) || '%' THEN 'lf' END AS main FROM documents""")
def line_ends(spark, sf_dir):
    n = C.eol_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n["lf"].alias("lf"), n["crlf"].alias("crlf"), n["cr"].alias("cr"), C.eol_main(F.col("text")).alias("main"))


@query("SELECT doc_id, len(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]', '', 'g'))::INT AS chars FROM documents")
def nonblank_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.nonblank_chars(F.col("text")).alias("chars"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("""
SELECT event_id, CASE WHEN date_diff('day', ts::DATE, DATE '2024-03-15') <= 0 THEN 'today' WHEN date_diff('day', ts::DATE, DATE '2024-03-15') = 1 THEN 'yesterday'
  WHEN ts::DATE >= date_trunc('week', DATE '2024-03-15')::DATE THEN 'week' ELSE 'earlier' END AS day FROM events""")
def day_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.day_group(F.col("ts"), F.lit("2024-03-15 12:00:00").cast("timestamp")).alias("day"))


@query("""
SELECT o_orderkey, CASE WHEN x < 1024 THEN x || ' B' ELSE (CASE WHEN t % 10 = 0 THEN (t // 10)::VARCHAR ELSE (t // 10) || '.' || (t % 10) END) || ' KB' END AS size
FROM (SELECT o_orderkey, (o_orderkey % 900000)::BIGINT AS x, floor((o_orderkey % 900000) / 1024.0 * 10 + 0.5)::BIGINT AS t FROM orders)""")
def size_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.size_format(F.col("o_orderkey") % 900000).alias("size"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, lpad((l_orderkey // 3600)::VARCHAR, 2, '0') || ':' || lpad((l_orderkey // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((l_orderkey % 60)::VARCHAR, 2, '0') || ',' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') AS clock
FROM lineitem""")
def cue_clocks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.clock(F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("clock"))


@query("""
SELECT p_partkey, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(65 + (i - 26) // 26) || chr(65 + i % 26) ELSE chr(65 + (i - 702) // 676) || chr(65 + (i - 702) // 26 % 26) || chr(65 + i % 26) END AS ref, i::BIGINT AS back
FROM (SELECT p_partkey, (p_partkey % 16384)::INT AS i FROM part)""")
def column_refs(spark, sf_dir):
    ref = C.column_ref(F.col("p_partkey") % 16384)
    return table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref"), C.column_index(ref).alias("back"))


@query("""
SELECT o_orderkey, CASE WHEN n = 60 THEN '1900-02-29' WHEN n < 60 THEN strftime(DATE '1899-12-31' + n, '%Y-%m-%d') ELSE strftime(DATE '1899-12-30' + n, '%Y-%m-%d') END AS day
FROM (SELECT o_orderkey, (o_orderkey % 60000)::INT AS n FROM orders)""")
def sheet_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.excel_date((F.col("o_orderkey") % 60000).cast("double")).alias("day"))


@query("""
SELECT o_orderkey, regexp_matches(t, '^-?(0|[1-9][0-9]*)(\\.[0-9]*[1-9])?$') AND len(regexp_replace(t, '[^0-9]', '', 'g')) <= 15 AS keeps
FROM (SELECT o_orderkey, o_totalprice::DECIMAL(18, 2)::VARCHAR AS t FROM orders)""")
def typed_cells(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.keeps_meaning(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("keeps"))


@query("""
SELECT p_partkey, regexp_replace(p_name, '[<>:"/\\\\|?*\\n\\r\\t]', '', 'g') || '_part' || lpad((p_partkey % 7 + 1)::VARCHAR, 2, '0') || '.csv' AS name FROM part""")
def part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.part_name(F.col("p_name"), F.col("p_partkey") % 7 + 1, F.lit(7), F.lit("csv")).alias("name"))


@query("""
WITH u AS (SELECT page_id, list_filter(string_split(url, '/'), lambda s: trim(s) <> '' AND s NOT IN ('.', '..')) AS s FROM pages),
j AS (SELECT page_id, array_to_string(list_transform(s, lambda x: regexp_replace(regexp_replace(x, '[\\x00-\\x1f:*?"<>|]', '_', 'g'), '^\\.+', '')), '_') AS n FROM u)
SELECT page_id, CASE WHEN len(n) <= 96 THEN n ELSE substr(n, 1, greatest(4, 96 - CASE WHEN regexp_extract(n, '\\.([^.]*)$', 1) = '' THEN 0 ELSE len(regexp_extract(n, '\\.([^.]*)$', 1)) + 1 END)) ||
  CASE WHEN regexp_extract(n, '\\.([^.]*)$', 1) = '' THEN '' ELSE '.' || regexp_extract(n, '\\.([^.]*)$', 1) END END AS name FROM j""")
def flat_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.flatten_path(F.col("url")).alias("name"))


@query("""
SELECT p_partkey, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS compared FROM (SELECT p_partkey, [p_size % 5, p_partkey % 10] AS a, [2, 5] AS b FROM part)""")
def versions(spark, sf_dir):
    own = F.concat(F.lit("v"), (F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".0"))
    return table(spark, sf_dir, "part").select("p_partkey", C.version_compare(own, F.lit("2.5")).alias("compared"))


@query("""
SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor(floor(x::DOUBLE * 10000) * 1.5 + 0.5), -32768), 32767)::INT) AS loud FROM embeddings""")
def pcm_gain(spark, sf_dir):
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", C.pcm_gain(samples, 150).alias("loud"))


@query("""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 10000)::INT) AS x FROM embeddings),
y AS (SELECT vec_id, x, 1 AS k, x[1]::BIGINT AS y FROM v UNION ALL SELECT vec_id, x, k + 1, x[k + 1] - x[k] + sign(y)::BIGINT * (abs(y) * 995 // 1000) FROM y WHERE k < len(x))
SELECT vec_id, list(CASE WHEN abs(y) < 500 THEN 0 ELSE least(greatest(y, -32768), 32767) END::INT ORDER BY k) AS clean FROM y GROUP BY 1""")
def pcm_denoise(spark, sf_dir):
    samples = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", C.pcm_denoise(samples, 2).alias("clean"))


@query("""
SELECT o_orderkey, CASE WHEN u > 0 AND u * 1000000 // d >= 200000 THEN least(u * 1000000 // d, 40000000)::BIGINT END AS bps FROM (
  SELECT o_orderkey, d, (floor(t * 8 * 0.94::DOUBLE)::BIGINT - 96000 * d // 1000000)::HUGEINT AS u FROM (SELECT o_orderkey, (o_orderkey % 5000 + 1) * 20000 AS t, 60000000::BIGINT AS d FROM orders))""")
def video_bitrates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.video_bitrate((F.col("o_orderkey") % 5000 + 1) * 20000, F.lit(60_000_000), F.lit(96000)).alias("bps"))


@query("""
SELECT p_partkey, w, h, round(least(595 / w, 842 / h), 9) AS scale FROM (SELECT p_partkey, (100 + p_size)::DOUBLE AS w, (200 + p_size)::DOUBLE AS h FROM part)""")
def page_resize(spark, sf_dir):
    w, h = (F.col("p_size") + 100).cast("double"), (F.col("p_size") + 200).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"), F.round(C.resize_page(w, h, F.lit(0), 595.0, 842.0)["scale_x"], 9).alias("scale"))


@query("SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn, role, text) AS merged FROM conversations GROUP BY 1")
def ordered_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    items = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(items, lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["text"])), "\n").alias("merged"))
