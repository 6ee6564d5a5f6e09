"""Text kernels: golden values and round trips."""

import json
import tomllib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import charset, config, csvtext, docparts, htmltext, markdown, sniff, sqldump, subtitles, tree, xmltext, yamltext
from tessera.functions.tree import FormatError, Number

SCALARS = st.one_of(st.none(), st.booleans(), st.text(max_size=12), st.integers(-(10**20), 10**20).map(lambda n: Number(str(n))))
TREES = st.recursive(SCALARS, lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.text(min_size=1, max_size=6), inner, max_size=4)), max_leaves=12)


# -- JSON and tables ----------------------------------------------------------------------------------------------------


def test_json_keeps_spelling_order_and_last_value():
    text = '{"b":1.50,"a":[1e20,-0],"b":12345678901234567890.10}'
    assert tree.render_json(tree.parse_json(text), None) == '{"b":12345678901234567890.10,"a":[1e20,-0]}'
    assert tree.render_json(tree.parse_json('{"b":[],"a":{}}'), 2, sort_keys=True) == '{\n  "a": {},\n  "b": []\n}'
    assert tree.render_json(["é"], None, ascii_only=True) == '["\\u00e9"]'
    for bad in ("{'a':1}", "[1,]", "NaN", "01", "[1] x", ""):
        with pytest.raises(FormatError):
            tree.parse_json(bad)


@given(TREES)
def test_json_round_trip(x):
    assert tree.parse_json(tree.render_json(x, 2)) == x
    json.loads(tree.render_json(x, None))


def test_tables_unite_columns_and_report_losses():
    columns, rows, notes = tree.to_table(tree.parse_json('[{"a":1.50,"b":[1,{"c":null}]},{"d":true,"a":null}]'))
    assert columns == ["a", "b", "d"] and rows == [["1.50", '[1,{"c":null}]', ""], ["", "", "true"]]
    assert notes == ["TYPES_LOST", "NESTED_PACKED", "NULL_AS_EMPTY"]
    assert tree.to_table([["1"], ["2", "3"]], "zh")[:2] == (["列1", "列2"], [["1", ""], ["2", "3"]])
    assert tree.to_table([Number("1"), None])[:2] == (["value"], [["1"], [""]])
    for bad in ({}, [], "x"):
        with pytest.raises(FormatError):
            tree.to_table(bad)


def test_records_to_objects():
    assert tree.from_records([["a", "a", " "], ["1", "007", "x", "beyond"], ["2"]], infer=True) == [{"a": "1", "a_2": "007", "column3": "x"}, {"a": "2", "a_2": "", "column3": ""}]
    assert isinstance(tree.scalar("1e5", True), Number) and tree.scalar("1e5") == "1e5" and tree.scalar(" true ", True) is True


def test_csv_keeps_everything():
    text = '﻿a;"b ""q""; c"\r\n1;"two\r\nlines"\r\n\r\n;x"y"\r\n'
    assert csvtext.parse_csv(text) == [["a", 'b "q"; c'], ["1", "two\r\nlines"], [""], ["", 'x"y"']]
    assert csvtext.parse_csv('a,"open\nrest') == [["a", "open\nrest"]]
    assert csvtext.parse_csv("") == [] and csvtext.parse_csv("\n") == [] and csvtext.parse_csv("a,") == [["a", ""]]
    assert csvtext.ragged_rows([["a", "b"], ["c"], ["d", "e"]]) == [2]
    assert csvtext.detect_delimiter('"a,b,c";d') == ";" and csvtext.detect_delimiter("abc") == "," and csvtext.detect_delimiter("a\tb|c|d") == "|"
    assert csvtext.render_csv([["a b", 'q"', "x,y", ""]], quote_all=False) == 'a b,"q""","x,y",\n'


@given(st.lists(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=8), min_size=2, max_size=4), min_size=1, max_size=5), st.sampled_from(csvtext.DELIMITERS))
def test_csv_round_trip(records, delimiter):
    assert csvtext.parse_csv("x\n" + csvtext.render_csv(records, delimiter), delimiter)[1:] == records


# -- trees --------------------------------------------------------------------------------------------------------------


@settings(max_examples=200)
@given(TREES)
def test_yaml_round_trip(x):
    assert yamltext.parse_yaml(yamltext.render_yaml(x)) == x


def test_yaml_core_schema():
    text = "a: yes\nb: 012\nc: 1:30\nd: 2001-01-01\ne: 1.50\nf: ~\ng: 'it''s'\nh: 0x1F\ni: .5\nj: 1e3\nk: \"\\u00e9\\n\"\n"
    assert yamltext.parse_yaml(text) == {"a": "yes", "b": "12", "c": "1:30", "d": "2001-01-01", "e": "1.50", "f": None, "g": "it's", "h": "31", "i": "0.5", "j": "1e3", "k": "é\n"}
    assert yamltext.parse_yaml("base: &b {x: 1, y: [2, 3]}\nown:\n  <<: *b\n  x: 9\n")["own"] == {"x": "9", "y": ["2", "3"]}
    assert yamltext.parse_yaml("|+\n a\n\n") == "a\n\n" and yamltext.parse_yaml(">-\n a\n b\n\n c\n") == "a b\nc"
    assert yamltext.parse_yaml("- a\n-\n  - b\n- c: 1\n  d: 2\n") == ["a", ["b"], {"c": "1", "d": "2"}]
    assert yamltext.parse_yaml("") is None and yamltext.parse_yaml("---\nx # note\n...\n") == "x"
    for bad in ("a: !!int 1", "? k\n: v", "\ta: 1", "a: 1\na: 2", "a: *none", "a: [1", "%YAML 1.2\n---\na", "a: 1\n  b: 2"):
        with pytest.raises(FormatError):
            yamltext.parse_yaml(bad)


def test_toml_agrees_with_the_standard_library():
    text = 'a = 1\nb.c = "x\\t"\nq = [1, 2, [3]] # c\n[t]\nd = 0xff\ne = \'\'\'\nraw\\\'\'\'\n[t.u]\nf = true\n[[r]]\nx = {y = 1, "z z" = 2}\n[[r]]\n[r.s]\nv = """\none \\\n   two"""\n'
    assert tree.render_json(config.parse_toml(text), None) == tree.render_json(tree.parse_json(json.dumps(tomllib.loads(text))), None)
    assert config.parse_toml("d = 1979-05-27 07:32:00\nf = 1_000.50\n") == {"d": "1979-05-27 07:32:00", "f": "1000.50"}
    for bad in ("a = 1\na = 2", "a = ", "[a]\n[a]", "a = nil", 'a = "x', "a = [1 2]", "a = 1 b"):
        with pytest.raises(FormatError):
            config.parse_toml(bad)
    with pytest.raises(FormatError):
        config.render_toml({"a": None})


@given(st.dictionaries(st.text(min_size=1, max_size=5), st.recursive(st.one_of(st.booleans(), st.text("abc é\"\\\n", max_size=6), st.integers().map(lambda n: Number(str(n)))), lambda i: st.one_of(st.lists(i, max_size=3), st.dictionaries(st.text(min_size=1, max_size=4), i, max_size=3)), max_leaves=8), max_size=4))
def test_toml_round_trip(x):
    assert config.parse_toml(config.render_toml(x)) == x


def test_ini():
    assert config.parse_ini("g = 1\n; note\n[s]\nk: v = w\nk = last\n[s]\nq = \"a b\"\n") == {"": {"g": "1"}, "s": {"k": "last", "q": "a b"}}
    assert config.render_ini({"g": Number("1"), "s": {"k": True}}) == "g = 1\n\n[s]\nk = true\n"
    for bad in ("[s", "word"):
        with pytest.raises(FormatError):
            config.parse_ini(bad)
    for bad in ([], {"s": {"a": []}}, {"s": {"a": None}}):
        with pytest.raises(FormatError):
            config.render_ini(bad)


def test_xml():
    text = '<?xml version="1.0" encoding="UTF-8"?><o b="2" a="1"><!-- c --><i>x<![CDATA[<y>]]></i><i/> t <n:j xmlns:n="u">1.50</n:j></o>'
    found = xmltext.parse_xml(text)
    assert found == {"o": {"@a": "1", "@b": "2", "#text": "t", "i": ["x<y>", None], "n:j": [{"@xmlns:n": "u", "#text": "1.50"}]}}
    assert xmltext.parse_xml(xmltext.render_xml(found)) == found
    assert xmltext.render_xml(["1", {"a": "<"}]).count("<item>") == 2
    for bad in ("<a>", "<!DOCTYPE a><a/>", "<a/><b/>", ""):
        with pytest.raises(FormatError):
            xmltext.parse_xml(bad)
    with pytest.raises(FormatError):
        xmltext.render_xml({"a b": "x"})


def test_xml_rows_are_chosen_by_count_keys_and_depth():
    text = "<c><m>x</m><r><b/><b/><b/></r><g><d k='1'><n>a</n></d><d><n>b</n><n>c</n></d><d/></g></c>"
    columns, rows, path, notes = xmltext.pick_rows(xmltext.parse_xml(text))
    assert path == "/c/g/d" and columns[:2] == ["@k", "n"] and rows[:2] == [["1", "a", ""], ["", '["b","c"]', ""]] and "PACKED" in notes
    with pytest.raises(FormatError):
        xmltext.pick_rows(xmltext.parse_xml("<a><b/></a>"))


def test_sql_dump():
    dump = "/* c */ CREATE TABLE IF NOT EXISTS db.`u v` (`id` INT NOT NULL, name TEXT DEFAULT 'x,y', PRIMARY KEY (`id`), KEY k (name));\nINSERT IGNORE INTO `u v` (name, id) VALUES ('a''b\\n;', 1), (NULL, 2);\nINSERT INTO other VALUES (1, 'x'); DROP TABLE z;"
    tables, notes = sqldump.parse_dump(dump)
    assert [(t.name, t.columns, t.rows) for t in tables] == [("u v", ["id", "name"], [["1", "a'b\n;"], ["2", None]]), ("other", ["c1", "c2"], [["1", "x"]])]
    assert notes == ["NULL_AS_EMPTY", "STATEMENTS_SKIPPED"] and tables[0].to_csv() == 'id,name\n1,"a\'b\n;"\n2,\n'


# -- subtitles ----------------------------------------------------------------------------------------------------------


def test_subtitles():
    srt = "1\n00:00:01,500 --> 00:00:03,000\nHi\nyou\n\n2\n00:00:02,000 --> 00:00:04,007\nx\n"
    cues = subtitles.parse_cues(srt)
    assert [(c.start_ms, c.end_ms, c.lines) for c in cues] == [(1500, 3000, ("Hi", "you")), (2000, 4007, ("x",))]
    for kind in ("srt", "vtt"):
        assert subtitles.parse_cues(subtitles.render_cues(cues, kind)) == cues
    assert subtitles.parse_cues("[offset:500]\n[00:02.5]a\n[00:04.00][00:10.00]b\n")[0] == subtitles.Cue(2000, 3500, ("a",))
    ass = "[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.5,0:00:02.00,{\\i1}a, b\\Nc\n"
    assert subtitles.parse_cues(ass) == [subtitles.Cue(1050, 2000, ("a, b", "c"))]
    assert subtitles.cue_notes(cues, "lrc") == ["OVERLAPPING:1", "END_LOST:2", "LINES_JOINED:1", "RESOLUTION_LOST:1"]
    assert subtitles.cue_at(cues, 2500).lines == ("x",) and subtitles.cue_at(cues, 4007) is None
    with pytest.raises(FormatError):
        subtitles.parse_cues("nothing")


# -- documents ----------------------------------------------------------------------------------------------------------


def test_html():
    page = "<html><head><title>T &amp; x</title><style>p{}</style></head><body><h2>Hi</h2><p>One <b>bold <i>x</b> y<p>Two &foo; &copy;&#233;<ol><li>a<ul><li>n</ul><li>b</ol><pre>k  l\nm</pre><a href='u v'>z</a><script>if (a<b) {}</script>"
    parts, counts = htmltext.html_parts(page)
    assert htmltext.html_title(page) == "T & x"
    assert docparts.to_text(parts) == "Hi\n\nOne bold x y\n\nTwo &foo; ©é\n\n1. a\n  - n\n2. b\n\nk  l\nm\n\nz\n"
    assert "[z](<u v>)" in docparts.to_markdown(parts)
    assert counts["unknown_entities"] == 1 and counts["links"] == 1 and counts["dropped"] == 1 and counts["repaired"] >= 1


def test_html_tables_place_spans():
    page = "<table><caption>c</caption><tr><th rowspan=2>a<th colspan=2>b<tr><td>1<td>2<br>3</table><table><td>loose<table><tr><td>inner</table></table>"
    assert htmltext.html_tables(page) == [("c", [["a", "b", ""], ["", "1", "2\n3"]]), ("", [["loose"]]), ("", [["inner"]])]


def test_markdown():
    text = "---\nt: x\n---\nTitle\n=====\n\n*a* **b** `c*d` ~~e~~ [l](http://x.y 't') <http://z.w> \\*q\\* [r]\n\n- [x] done\n- one\n    - two\n\n3. n\n\n| h | i |\n|---|---|\n| 1 |\n\n```\nx\n```\n> q\n\n[r]: http://r.r\n"
    parts, notes = markdown.markdown_parts(text)
    assert notes["front_matter"] == 1 and notes["links"] == 2
    assert [p.style for p in parts if isinstance(p, docparts.Para)] == ["h1", "body", "body", "body", "body", "body", "code", "quote"]
    assert docparts.to_text(parts).startswith("Title\n\na b c*d e l http://z.w *q* r\n\n- ☑ done\n- one\n  - two\n1. n\n")
    again = markdown.markdown_parts(docparts.to_markdown(parts))[0]
    assert docparts.to_html(again) == docparts.to_html(parts)


# -- bytes --------------------------------------------------------------------------------------------------------------


def test_charsets():
    text = "中文字符，编码测试"
    assert charset.recognise(text.encode("gb18030"))[0] == "gb18030" and charset.recognise(text.encode())[0] == "utf-8"
    assert charset.decode(b"\xff\xfe" + "aé".encode("utf-16-le")) == ("aé", "utf-16-le", ["ENCODING:utf-16-le", "MARK"])
    assert charset.encode("é", "utf-8", True) == b"\xef\xbb\xbf\xc3\xa9" and charset.to_eol("a\r\nb\rc\n", "crlf") == "a\r\nb\r\nc\r\n"
    with pytest.raises(FormatError, match="2 characters"):
        charset.encode("a中é中", "latin-1")


def test_sniffing():
    heads = {"png": b"\x89PNG\r\n\x1a\n0000", "wav": b"RIFF0000WAVEfmt ", "html": b"\xef\xbb\xbf <!DOCTYPE html>", "json": b' {"a": 1, "b": 2}', "xml": b"<?xml version='1.0'?><a/>", "rtf": b"{\\rtf1\\ansi abc}", "unknown": b"\0\1\2\3" * 4, "text": b"plain words here", "m4a": b"\0\0\0\x20ftypM4A \0\0"}
    assert {k: sniff.sniff(v) for k, v in heads.items()} == {k: k for k in heads}
    assert sniff.sniff(b"") == "unknown" and sniff.sniff(b"short") == "text"
