"""Queries over the driver's tables for formats: trees, tables, HTML, subtitles, archives, sheets. SQL builds the same text where it can."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions import htmltext
from tessera.operators import convert as V
from tessera.operators import geometry
from tessera.plans import catalogue
from tessera.plans.relational_queries import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _props(operation: str, sql: str, **parameters) -> None:
    """A query that converts the events' JSON."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return V.convert_text(table(spark, sf_dir, "events"), operation, "event_id", "props", **parameters).select("event_id", "output")

    run.__name__ = operation
    query(f"SELECT event_id, {sql} AS output FROM events")(run)


_K = "(props->>'$.k')"
_props("format_json", f"'{{' || chr(10) || '  \"k\": ' || {_K} || chr(10) || '}}' || chr(10)")
_props("json_to_yaml", f"'k: ' || {_K} || chr(10)")
_props("json_to_toml", f"'k = ' || {_K} || chr(10)")
_props("json_to_ini", f"'k = ' || {_K} || chr(10)")
_props("json_to_xml", f"'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<k>' || {_K} || '</k>' || chr(10)")


def _orders_as(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Orders with a text of literal pieces and, in braces, column names."""
    return table(spark, sf_dir, "orders").select("o_orderkey", _text(*parts).alias("text"))


def _text(*parts: str) -> Column:
    return F.concat(*(F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts))


_INI = ("status = ", "{o_orderstatus}", "\n[order]\nkey: ", "{o_orderkey}", "\n")
_INI_JSON = """'{' || chr(10) || '  "status": "' || o_orderstatus || '",' || chr(10) || '  "order": {' || chr(10) || '    "key": "' || o_orderkey || '"' || chr(10) || '  }' || chr(10) || '}' || chr(10)"""


@query(f"SELECT o_orderkey, {_INI_JSON} AS output FROM orders")
def ini_to_json(spark, sf_dir):
    return V.convert_text(_orders_as(spark, sf_dir, *_INI), "ini_to_json", "o_orderkey", "text").select("o_orderkey", "output")


@query("SELECT o_orderkey, 'status: ' || o_orderstatus || chr(10) || 'order:' || chr(10) || '  key: \"' || o_orderkey || '\"' || chr(10) AS output FROM orders")
def ini_to_yaml(spark, sf_dir):
    return V.convert_text(_orders_as(spark, sf_dir, *_INI), "ini_to_yaml", "o_orderkey", "text").select("o_orderkey", "output")


_TOML = ("status = \"", "{o_orderstatus}", "\"\n[[line]]\nkey = ", "{o_orderkey}", "\ntext = 'a,b'\n[[line]]\nkey = 0\n")


@query("""SELECT o_orderkey, 'key,text' || chr(10) || o_orderkey || ',"a,b"' || chr(10) || '0,' || chr(10) AS output FROM orders""")
def toml_to_csv(spark, sf_dir):
    return V.convert_text(_orders_as(spark, sf_dir, *_TOML), "toml_to_csv", "o_orderkey", "text").select("o_orderkey", "output")


_YAML = ("- key: ", "{o_orderkey}", "\n  status: &s ", "{o_orderstatus}", "\n- {key: 1.50, status: *s}\n")


@query("""SELECT o_orderkey, '[' || chr(10) || '  {' || chr(10) || '    "key": ' || o_orderkey || ',' || chr(10) || '    "status": "' || o_orderstatus || '"' || chr(10) || '  },' || chr(10) || '  {' || chr(10)
  || '    "key": 1.50,' || chr(10) || '    "status": "' || o_orderstatus || '"' || chr(10) || '  }' || chr(10) || ']' || chr(10) AS output FROM orders""")
def yaml_to_json(spark, sf_dir):
    return V.convert_text(_orders_as(spark, sf_dir, *_YAML), "yaml_to_json", "o_orderkey", "text").select("o_orderkey", "output")


_XML = ("<orders><meta>x</meta><order id='", "{o_orderkey}", "'><status>", "{o_orderstatus}", "</status></order><order id='0'><status>a&amp;b</status><note/></order></orders>")


@query("SELECT o_orderkey, '@id,status,note' || chr(10) || o_orderkey || ',' || o_orderstatus || ',' || chr(10) || '0,a&b,' || chr(10) AS output FROM orders")
def xml_to_csv(spark, sf_dir):
    return V.convert_text(_orders_as(spark, sf_dir, *_XML), "xml_to_csv", "o_orderkey", "text").select("o_orderkey", "output")


@query("SELECT c_custkey, '[' || chr(10) || '  {' || chr(10) || '    \"name\": \"' || c_name || '\",' || chr(10) || '    \"key\": ' || c_custkey || chr(10) || '  }' || chr(10) || ']' || chr(10) AS output FROM customer")
def csv_to_json(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", _text("name,key\n", "{c_name}", ",", "{c_custkey}", "\n").alias("text"))
    return V.convert_text(rows, "csv_to_json", "c_custkey", "text", infer=True).select("c_custkey", "output")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'id,name' || chr(10) || n_nationkey || ',' || n_name || chr(10) || ',it''s' || chr(10) AS output FROM nation")
def sql_to_csv(spark, sf_dir):
    dump = _text("-- dump\nCREATE TABLE `nation` (id INT, name VARCHAR(25), PRIMARY KEY (id));\nINSERT INTO nation VALUES (", "{n_nationkey}", ",'", "{n_name}", "'),(NULL,'it''s');")
    return V.convert_text(table(spark, sf_dir, "nation").select("n_nationkey", dump.alias("text")), "sql_to_csv", "n_nationkey", "text").select("n_nationkey", "output")


@query("""
WITH c AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS s, event_type AS t FROM events),
f AS (SELECT user_id, s, event_id, lpad((s // 3600000 % 24)::VARCHAR, 2, '0') || ':' || lpad((s // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((s // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((s % 1000)::VARCHAR, 3, '0') AS c, t FROM c)
SELECT user_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(c || ' --> ' || c || chr(10) || t || chr(10) || chr(10), '' ORDER BY c, event_id) AS output FROM f GROUP BY 1""")
def convert_subtitle(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp")) % 86_400_000
    events = table(spark, sf_dir, "events").select("user_id", F.struct(ms.alias("ms"), "event_id", "event_type").alias("cue"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("cue")), lambda c: F.concat(F.lit("1\n"), C.clock(c["ms"]), F.lit(" --> "), C.clock(c["ms"]), F.lit("\n"), c["event_type"], F.lit("\n\n"))), "")
    return V.convert_text(events.groupBy("user_id").agg(body.alias("text")), "convert_subtitle", "user_id", "text", target="vtt").select("user_id", "output")


@query("SELECT doc_id, sha256(regexp_replace(text, chr(10), chr(13) || chr(10), 'g')) AS digest FROM documents")
def convert_text_encoding(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit("d.txt").alias("name"), F.encode("text", "UTF-16LE").alias("content"))
    out = V.convert(files, "convert_text_encoding", source="utf-16-le", target="utf-8", eol="crlf")
    return out.select(F.col("file_id").alias("doc_id"), F.sha2("content", 256).alias("digest"))


# -- HTML ---------------------------------------------------------------------------------------------------------------


def _html(name: str, kind: str, f: Callable[[str], object], arrow: pa.DataType) -> Callable[[DataFrame], DataFrame]:
    def run(pages: DataFrame) -> DataFrame:
        def batches(it):
            for b in it:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else f(x) for x in b.column(1).to_pylist()], arrow)], names=["page_id", name])

        return pages.select("page_id", "html").mapInArrow(batches, f"page_id long, {name} {kind}")

    return run


@query("SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '&copy;', '©'), '&middot;', '·')) AS title FROM pages")
def html_title(spark, sf_dir):
    return _html("title", "string", htmltext.html_title, pa.string())(table(spark, sf_dir, "pages"))


@query("SELECT page_id, len(regexp_extract_all(html, '<li[ >]')) AS items, len(regexp_extract_all(html, '<a[ >]')) AS links FROM pages")
def html_counts(spark, sf_dir):
    def count(html: str) -> dict:
        root = htmltext.parse_html(html)[0]
        return {"items": len(htmltext.find_all(root, "li")), "links": len(htmltext.find_all(root, "a"))}

    found = _html("n", "struct<items:long,links:long>", count, pa.struct([("items", pa.int64()), ("links", pa.int64())]))(table(spark, sf_dir, "pages"))
    return found.select("page_id", "n.items", "n.links")


@query("SELECT page_id, 'html' AS kind, 'text' AS family, strlen(html) AS size FROM pages")
def sniffed_kinds(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("name"), F.encode("html", "UTF-8").alias("content"))
    return V.sniffed(files).select(F.col("file_id").alias("page_id"), "kind", "family", "size")


@query()
def html_text(spark, sf_dir):
    return V.convert_text(table(spark, sf_dir, "pages"), "html_to_text", "page_id", "html").select("page_id", "output", "notes")


@query()
def html_markdown(spark, sf_dir):
    return V.convert_text(table(spark, sf_dir, "pages"), "html_to_markdown", "page_id", "html").select("page_id", "output")


@query()
def html_docx_text(spark, sf_dir):
    """HTML to Markdown, by docx and back to text: the document model through a container."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.lit("p").alias("name"), F.encode("html", "UTF-8").alias("content"))
    there = V.convert(V.convert(files, "html_to_markdown"), "text_to_docx")
    return V.convert(there, "docx_to_text").select(F.col("file_id").alias("page_id"), F.decode("content", "UTF-8").alias("output"))


@query("""
WITH t AS (SELECT n_regionkey::BIGINT AS page_id, string_agg('<tr><td>' || n_nationkey || '<td>' || n_name, '' ORDER BY n_nationkey) AS h, string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS c FROM nation GROUP BY 1)
SELECT page_id, 'id,name' || chr(10) || c AS output FROM t""")
def html_to_csv(spark, sf_dir):
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("<tr><td>"), x["n_nationkey"].cast("string"), F.lit("<td>"), x["n_name"])), "")
    pages = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(F.concat(F.lit("<table><tr><th>id</th><th>name</th></tr>"), rows, F.lit("</table>")).alias("html"))
    return V.convert_text(pages, "html_to_csv", "page_id", "html").select("page_id", "output")


# -- containers ---------------------------------------------------------------------------------------------------------


@query("SELECT n_regionkey::BIGINT AS region, string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS output FROM nation GROUP BY 1")
def sheet_round_trip(spark, sf_dir):
    """CSV to xlsx to ods to CSV."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(","), x["n_name"], F.lit("\n"))), "")
    files = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("file_id")).agg(F.lit("r.csv").alias("name"), F.encode(text, "UTF-8").alias("content"))
    back = V.convert(V.convert(V.convert(files, "csv_to_xlsx"), "xlsx_to_csv"), "csv_to_ods")
    return V.convert(back, "ods_to_csv").select(F.col("file_id").alias("region"), F.decode("content", "UTF-8").alias("output"))


@query("SELECT conv_id, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY 1")
def pack_and_unpack(spark, sf_dir):
    """Each conversation as a zip of its turns, unpacked again."""
    files = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("file_id"), F.concat("role", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    zipped = V.packed(files, "conv_id").select(F.col("batch").alias("file_id"), F.lit("c.zip").alias("name"), "content")
    out = V.convert(zipped, "unpack_zip")
    return out.groupBy(F.col("file_id").alias("conv_id")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@query("""
WITH w AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*))
SELECT l_orderkey AS file_id, 1 AS page, l_linenumber::INT AS row_no, [l_linenumber::VARCHAR, l_returnflag, l_linestatus] AS cells FROM lineitem JOIN w USING (l_orderkey)""")
def words_to_tables(spark, sf_dir):
    """An order's lines laid out as words at three columns, found again as a table."""
    items = table(spark, sf_dir, "lineitem")
    whole = items.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"), F.count_distinct("l_linenumber").alias("d")).where("n > 1 AND m = n AND d = n")
    cells = F.array(*(F.struct(t.cast("string").alias("text"), F.lit(100.0 * k).alias("left")) for k, t in enumerate((F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")))))
    words = items.join(whole.select("l_orderkey"), "l_orderkey").select(F.col("l_orderkey").alias("file_id"), F.lit(1).alias("page"), (F.col("l_linenumber") * 20.0).alias("top"), F.explode(cells).alias("c"))
    placed = words.select("file_id", "page", "c.text", "c.left", (F.col("c.left") + 8).alias("right"), "top", (F.col("top") + 10).alias("bottom"))
    return geometry.tables_from_words(placed).select("file_id", "page", "row_no", "cells")


@query()
def operation_catalogue(spark, sf_dir):
    return catalogue.operation_table(spark)
