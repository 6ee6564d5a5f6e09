"""More format queries: each kind of file over a small table, its text built again by SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import audio
from tessera.operators import convert as V
from tessera.plans.format_queries import _text
from tessera.plans.relational_queries import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, run: Query, sql: str | None = None) -> None:
    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _suppliers(operations: list[str], parts: tuple[str, ...], **parameters) -> Query:
    """A text for each supplier, through conversions one after the other."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.lit("s").alias("name"), F.encode(_text(*parts), "UTF-8").alias("content"))
        for k, operation in enumerate(operations):
            files = V.convert(files, operation, **(parameters if k == len(operations) - 1 else {})).select("file_id", "name", "content")
        return files.select(F.col("file_id").alias("s_suppkey"), F.decode("content", "UTF-8").alias("output"))

    return run


_N = "chr(10)"
_MARKDOWN = ("# Supplier\n\nkey **", "{s_suppkey}", "** of *", "{s_nationkey}", "*\n\n- ", "{s_name}", "\n- x\n")
_MARKDOWN_SQL = f"SELECT s_suppkey, '# Supplier' || {_N} || {_N} || 'key **' || s_suppkey || '** of *' || s_nationkey || '*' || {_N} || {_N} || '- ' || s_name || {_N} || '- x' || {_N} AS output FROM supplier"
for _kind in ("docx", "odt", "rtf"):
    query(f"{_kind}_round_trip", _suppliers([f"text_to_{_kind}", f"{_kind}_to_markdown"], _MARKDOWN), _MARKDOWN_SQL)
query("epub_round_trip", _suppliers(["text_to_epub", "epub_to_markdown"], _MARKDOWN), _MARKDOWN_SQL)
query("docx_to_html", _suppliers(["text_to_docx", "docx_to_html", "html_to_markdown"], _MARKDOWN), _MARKDOWN_SQL)
query("odt_to_docx", _suppliers(["text_to_odt", "odt_to_docx", "docx_to_markdown"], _MARKDOWN), _MARKDOWN_SQL)
query("md_to_text", _suppliers(["md_to_text"], _MARKDOWN), f"SELECT s_suppkey, 'Supplier' || {_N} || {_N} || 'key ' || s_suppkey || ' of ' || s_nationkey || {_N} || {_N} || '- ' || s_name || {_N} || '- x' || {_N} AS output FROM supplier")

_CSV = ("id,name\n", "{s_suppkey}", ",", "{s_name}", "\n")
query("csv_to_yaml", _suppliers(["csv_to_yaml"], _CSV), f"SELECT s_suppkey, '- id: \"' || s_suppkey || '\"' || {_N} || '  name: ' || s_name || {_N} AS output FROM supplier")
query("csv_to_xml", _suppliers(["csv_to_xml"], _CSV), f"SELECT s_suppkey, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || {_N} || '<rows>' || {_N} || '  <row>' || {_N} || '    <id>' || s_suppkey || '</id>' || {_N} || '    <name>' || s_name || '</name>' || {_N} || '  </row>' || {_N} || '</rows>' || {_N} AS output FROM supplier")
query("csv_to_html", _suppliers(["csv_to_html", "html_to_csv"], _CSV), f"SELECT s_suppkey, 'id,name' || {_N} || s_suppkey || ',' || s_name || {_N} AS output FROM supplier")

_TOML = ("id = ", "{s_suppkey}", "\n[s]\nname = \"", "{s_name}", "\"\nd = 1979-05-27\n")
query("toml_to_json", _suppliers(["toml_to_json"], _TOML), f"SELECT s_suppkey, '{{' || {_N} || '  \"id\": ' || s_suppkey || ',' || {_N} || '  \"s\": {{' || {_N} || '    \"name\": \"' || s_name || '\",' || {_N} || '    \"d\": \"1979-05-27\"' || {_N} || '  }}' || {_N} || '}}' || {_N} AS output FROM supplier")
query("toml_to_yaml", _suppliers(["toml_to_yaml"], _TOML), f"SELECT s_suppkey, 'id: ' || s_suppkey || {_N} || 's:' || {_N} || '  name: ' || s_name || {_N} || '  d: \"1979-05-27\"' || {_N} AS output FROM supplier")
query("toml_to_ini", _suppliers(["toml_to_ini"], _TOML), f"SELECT s_suppkey, 'id = ' || s_suppkey || {_N} || {_N} || '[s]' || {_N} || 'name = ' || s_name || {_N} || 'd = 1979-05-27' || {_N} AS output FROM supplier")
query("toml_by_yaml", _suppliers(["toml_to_yaml", "yaml_to_toml"], _TOML), f"SELECT s_suppkey, 'id = ' || s_suppkey || {_N} || {_N} || '[s]' || {_N} || 'name = \"' || s_name || '\"' || {_N} || 'd = 1979-05-27' || {_N} AS output FROM supplier")
query("ini_to_toml", _suppliers(["ini_to_toml"], ("a=1\n[s]\nname=", "{s_name}", "\n")), f"SELECT s_suppkey, '[global]' || {_N} || 'a = \"1\"' || {_N} || {_N} || '[s]' || {_N} || 'name = \"' || s_name || '\"' || {_N} AS output FROM supplier")
query("yaml_to_csv", _suppliers(["yaml_to_csv"], ("- id: ", "{s_suppkey}", "\n  name: ", "{s_name}", "\n- other: [1, 2]\n")), f"SELECT s_suppkey, 'id,name,other' || {_N} || s_suppkey || ',' || s_name || ',' || {_N} || ',,\"[1,2]\"' || {_N} AS output FROM supplier")

_XML = ("<s k='", "{s_suppkey}", "'><n>", "{s_name}", "</n><n>x</n></s>")
query("xml_to_json", _suppliers(["xml_to_json"], _XML), f"SELECT s_suppkey, '{{' || {_N} || '  \"s\": {{' || {_N} || '    \"@k\": \"' || s_suppkey || '\",' || {_N} || '    \"n\": [' || {_N} || '      \"' || s_name || '\",' || {_N} || '      \"x\"' || {_N} || '    ]' || {_N} || '  }}' || {_N} || '}}' || {_N} AS output FROM supplier")
query("xml_by_yaml", _suppliers(["xml_to_yaml", "yaml_to_xml"], _XML), f"SELECT s_suppkey, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || {_N} || '<s k=\"' || s_suppkey || '\">' || {_N} || '  <n>' || s_name || '</n>' || {_N} || '  <n>x</n>' || {_N} || '</s>' || {_N} AS output FROM supplier")


def _tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a tar.gz of its turns, unpacked again."""
    files = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("file_id"), F.concat("role", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    packed = V.packed(files, "conv_id", "tar").select(F.col("batch").alias("file_id"), F.lit("c.tgz").alias("name"), "content")
    return V.convert(packed, "untar").groupBy(F.col("file_id").alias("conv_id")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


query("tar_round_trip", _tar, "SELECT conv_id, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY 1")


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as WAV files, made louder."""

    def waves(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["v.wav"] * b.num_rows), pa.array([audio.write_wav(audio.Pcm(8000, 1, np.array(x, dtype=np.int16))) for x in b.column(1).to_pylist()], pa.binary())], names=["file_id", "name", "content"])

    def samples(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([audio.read_wav(x).samples.astype(np.int32) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["vec_id", "loud"])

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000).cast("int")).alias("x"))
    louder = V.convert(vectors.mapInArrow(waves, "file_id long, name string, content binary"), "audio_volume", percent=150)
    return louder.select("file_id", "content").mapInArrow(samples, "vec_id long, loud array<int>")


query("audio_volume", _volume, "SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor(floor(x::DOUBLE * 10000) * 1.5 + 0.5), -32768), 32767)::INT) AS loud FROM embeddings")


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as document properties: a new title, other standard ones as they are, custom ones kept."""
    properties = F.create_map(F.lit("Title"), F.col("c_name"), F.lit("Company"), F.col("c_mktsegment"))
    patched = C.metadata_patch(properties, "edit", {"Title": " New ", "Author": "A", "Subject": ""})
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_sort(F.transform(F.map_entries(patched), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("properties"))


query("document_properties", _properties, "SELECT c_custkey, ['Author=A', 'Company=' || c_mktsegment, 'Title=New'] AS properties FROM customer")


def _form(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = C.form_values(_text("name = ", "{s_name}", "\nkey=0\nkey=", "{s_suppkey}", "\nnothing\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", values["name"].alias("name"), values["key"].alias("key"), F.size(values).alias("fields"))


query("form_values", _form, "SELECT s_suppkey, s_name AS name, s_suppkey::VARCHAR AS key, 2 AS fields FROM supplier")
