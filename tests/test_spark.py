"""Operators on Spark: columns, relational steps, conversions, drop folders, and all queries with SQL against DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import columns as C
from tessera.operators import convert as V
from tessera.operators import geometry
from tessera.operators import relational as R
from tessera.plans import catalogue, registry
from tessera.sources import files
from tessera.streaming import dropfolder

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(spark, column, texts, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], f"k int, x {kind}").select("k", column(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_sizes_and_times(spark):
    assert values(spark, C.size_parse, ["1.5 GB", "300k", "2", "1,5 MB", "0", "x", "3 tb", ""]) == [1610612736, 307200, 2097152, 15728640, None, None, 3 << 40, None]
    assert values(spark, C.size_format, [0, 1023, 1024, 1536, 1048575, 1 << 20, 3 << 30], "long") == ["0 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "1 MB", "3 GB"]
    assert values(spark, C.time_seconds, ["90", "1:30", "1:02:03.5", "", "1:2:3:4", "-1", "a"]) == [90.0, 90.0, 3723.5, None, None, None, None]
    assert [[tuple(r) for r in x] for x in values(spark, C.time_ranges, ["0-10,1:00-", "5-2,x,7"])] == [[(0.0, 10.0), (60.0, None)], [(7.0, None)]]


def test_names_and_versions(spark):
    assert values(spark, C.stem, ["a/b.tar.gz", ".hidden", "x", "c\\d.e"]) == ["b.tar", ".hidden", "x", "d"]
    assert values(spark, C.extension, ["a.PDF", "a.", "a"]) == ["pdf", "pdf", "pdf"] and values(spark, C.sanitize, ['a<b>:"/c. ', "???"]) == ["abc", "file"]
    assert values(spark, C.flatten_path, ["../a/./b c.txt", "..", "x:y\x01/.z", "d/" + "n" * 120 + ".txt"]) == ["a_b c.txt", "unnamed", "x_y__z", ("d_" + "n" * 90) + ".txt"]
    assert values(spark, lambda x: C.version_compare(x, F.lit("1.2")), ["v1.2.0", "1.10", "1.1.9", "1", "1.x"]) == [0, 1, -1, None, None]
    digest = "ab" * 32
    assert values(spark, lambda x: C.digest_from_notes(x, F.lit("App.apk")), [f"app.APK {digest.upper()}\nother {'cd' * 32}", f"only {digest}", f"{digest} {'cd' * 32}", "none"]) == [digest, digest, None, None]


def test_text_columns(spark):
    assert values(spark, C.ocr_normalize, ["a  \r\nb\r\r\r\rc \n"]) == ["a\nb\n\nc"] and values(spark, C.eol_main, ["a\r\nb\n", "a\rb\r\n\r", "x"]) == ["crlf", "cr", None]
    assert values(spark, lambda x: C.csv_cell(x, ";"), ['a"b', "a;b", "a,b", None, " x "]) == ['"a""b"', '"a;b"', "a,b", "", " x "]
    assert values(spark, lambda x: C.json_literal(x, True), ["1.50", "007", "true", 'q"', None]) == ["1.50", '"007"', "true", '"q\\""', '""']
    assert values(spark, C.keeps_meaning, ["1.5", "1.50", "007", "-0", "12"]) == [True, False, False, False, True]
    assert values(spark, C.excel_date, [1.0, 60.0, 61.5], "double") == ["1900-01-01", "1900-02-29", "1900-03-01 12:00:00"]
    assert values(spark, lambda x: C.pcm_denoise(x, 1), [[1000, 1000, -3000]], "array<int>") == [[1000, 995, -3010]]


def test_document_properties(spark):
    maps = [{"Title": "t", "Company": "c", "ModDate": "d"}]
    kind = "map<string,string>"
    assert values(spark, lambda x: C.metadata_patch(x, "edit", {"Title": " n ", "Author": "", "Other": "x"}), maps, kind) == [{"Title": "n", "Company": "c", "ModDate": "d"}]
    assert values(spark, lambda x: C.metadata_patch(x, "clear"), maps, kind) == [{}] and values(spark, lambda x: C.metadata_patch(x, "clear-standard", keep_dates=True), maps, kind) == [{"Company": "c", "ModDate": "d"}]
    assert values(spark, C.form_values, ["a = 1=2\r\nb\n=x\na=3\nc="]) == [{"a": "3", "c": ""}]
    boxes = spark.range(1).select(C.crop_page(F.lit(0), F.lit(0), F.lit(100), F.lit(50), 10).alias("a"), C.crop_page(F.lit(0), F.lit(0), F.lit(100), F.lit(20), 10).alias("b")).first()
    assert tuple(boxes.a) == (10, 10, 90, 40) and boxes.b is None


def test_page_specs(spark):
    assert values(spark, lambda x: R.spec_pages(x, F.lit(5)), ["3,5-4", "-2;4-", "6", "0", "a", "2-3-4", "-", "", "1 1"]) == [[3, 5, 4], [1, 2, 4, 5], None, None, None, None, None, None, [1, 1]]


def test_splits_and_names(spark):
    sizes = [5, 5, 5, 20, 1, 1]
    pages = spark.createDataFrame([(1, k, s) for k, s in enumerate(sizes)], "d int, p int, s int")
    assert [r.part for r in sorted(R.split_by_size(pages, "d", "p", "s", 10).collect(), key=lambda r: r.p)] == [1, 1, 2, 3, 4, 4]
    names = ["a.txt", "a.txt", "a (2).txt", "a.txt", "b", "b", ".x", ".x"]
    rows = R.unique_names(spark.createDataFrame([(1, k, n) for k, n in enumerate(names)], "b int, k int, n string"), "b", "k", "n").collect()
    assert [r.unique_name for r in sorted(rows, key=lambda r: r.k)] == ["a.txt", "a (2).txt", "a (2) (2).txt", "a (3).txt", "b", "b (2)", ".x", ".x (2)"]


def test_lookups_keep_repeated_points_and_bear_long_intervals(spark):
    points = spark.createDataFrame([("a", 5), ("a", 5), ("a", 5), ("a", 10**12), ("b", 5), (None, 1)], "k string, t long")
    intervals = spark.createDataFrame([("a", 0, 10**15, 1, "long"), ("a", 4, 6, 2, "short"), ("a", 9, 9, 3, "none"), ("b", 6, 7, 4, "late")], "k string, s long, e long, o int, v string")
    found = R.interval_lookup(points, intervals, "k", "t", "s", "e", "o", "v").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([("a", 5, "short")] * 3 + [("a", 10**12, "long"), ("b", 5, None), (None, 1, None)], key=repr)
    assert R.interval_lookup(points, intervals.limit(0), "k", "t", "s", "e", "o", "v").count() == 6


def test_what_is_too_large_or_damaged_is_a_row(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "b.bin").write_bytes(b"1234567890")
    rows = {r.name: (r.content and bytes(r.content), r.error) for r in files.read_files(spark, str(tmp_path), most_bytes=5).collect()}
    assert rows == {"a.bin": (b"12345", None), "b.bin": (None, "too_large")}
    words = geometry.words_from_files(spark.createDataFrame([(1, b"no")], "file_id long, content binary"))
    assert [(r.file_id, r.text, bool(r.error)) for r in words.collect()] == [(1, None, True)] and geometry.tables_from_words(words).count() == 0


def test_conversions_report_errors_by_row(spark):
    rows = [(1, "a.json", b'[{"a":1.50},{"b":"x"}]'), (2, "b.json", b"{"), (3, "c.json", None), (4, "d.json", b"[]")]
    out = {r.file_id: r for r in V.convert(spark.createDataFrame(rows, "file_id long, name string, content binary"), "json_to_csv").collect()}
    assert bytes(out[1].content) == b"a,b\n1.50,\n,x\n" and out[1].name == "a.csv" and out[1].notes == ["TYPES_LOST", "UNEVEN_WIDTHS"] or "TYPES_LOST" in out[1].notes
    assert all(out[k].content is None and out[k].error for k in (2, 3, 4))
    assert V.convert(spark.createDataFrame([], "file_id long, name string, content binary"), "json_to_csv").count() == 0


def test_tree_conversions_agree_whatever_the_way(spark):
    text = 'a = 1\n[t]\nx = "yes"\ny = [1, 2]\n'
    there = V.KERNELS["toml_to_yaml"](text.encode(), "f")[0][0][1]
    assert V.KERNELS["yaml_to_json"](there, "f") == V.KERNELS["toml_to_json"](text.encode(), "f")
    assert V.KERNELS["yaml_to_toml"](there, "f") == V.KERNELS["json_to_toml"](V.KERNELS["toml_to_json"](text.encode(), "f")[0][0][1], "f")


def test_files_and_drop_folder(spark, tmp_path):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()
    (drop / "a.json").write_text('{"k": 1.50}')
    (drop / "b.json").write_text("{")
    assert files.file_list(spark, str(drop)).count() == 2 and files.read_files(spark, str(drop), "a*").first().size == 11
    for _ in range(2):  # the second time nothing is new
        dropfolder.convert_arrivals(spark, str(drop), "json_to_yaml", str(out), str(tmp_path / "state")).awaitTermination(60)
    rows = spark.read.parquet(str(out)).collect()
    assert sorted((bytes(r.content or b""), r.error is None) for r in rows) == [(b"", False), (b"k: 1.50\n", True)]
    written = files.write_files(spark.read.parquet(str(out)), str(tmp_path / "files")).collect()
    assert len(written) == 1 and open(written[0].path).read() == "k: 1.50\n"


def test_catalogue(spark):
    found = catalogue.operations()
    assert len({o.name for o in found}) == len(found) and all((o.done_by is None) != (o.reason is None) for o in found)
    assert set(V.KERNELS) <= {o.name for o in found}


def test_catalogue_claims_no_helper_as_an_operation():
    done = {o.name: o.done_by for o in catalogue.operations() if o.done_by}
    assert all(by == f"convert.{name}" and name in V.KERNELS or by == "convert.packed" for name, by in done.items())


def norm(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    rows, names = df.collect(), sorted(df.columns)
    if name not in registry.ORACLES:
        assert rows
        return
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]"}
    assert {c: kinds.get(t, t) for c, t in df.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(norm(r[c]) for c in names) for r in rows), key=repr) == sorted((tuple(norm(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_overlap_counts_round_halves_as_sql(spark, tmp_path):
    # a hundredfold that is a half: the even neighbour gives a cue of no length
    halves = [v for j in range(200) if (v := (7000 * j + 100.5) / 100) * 100 == 7000 * j + 100.5]
    rows = [(k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k), k % 3, "view", v, "{}") for k, v in enumerate(halves)]
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, entry.queries()["overlap_counts"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(db.sql(entry.oracle_sql()["overlap_counts"]).fetchall())
