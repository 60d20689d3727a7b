import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import markup
from lodestone.operators import chunks, examples, stats
from lodestone.plans.catalog import MODULE, TOC
from lodestone.sources import help_book, jsonl, modules
from lodestone.streaming.incremental import merged_scan, watch


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def block(data, payload=None, following="ffffffff"):
    return f"\r\n{len(data) if payload is None else payload:08x} {len(data):08x} {following} \r\n".encode() + data


def book(entities):
    """A container as the reader expects it; bodies are split over two blocks."""
    places, rest = [], b""
    begin = 16 + 31 + 12 * len(entities)
    for name, body in entities.items():
        header = begin + len(rest)
        rest += block(b"\0" * 20 + name.encode("utf-16-le") + b"\0\0\0\0")
        at = begin + len(rest)
        half = len(body) // 2
        rest += block(body[:half], len(body), f"{at + 31 + half:08x}") + block(body[half:])
        places.append(struct.pack("<3i", header, at, help_book.NONE))
    return b"\0" * 16 + block(b"".join(places)) + rest


PAGES = {"root.html": "<h1>Корень</h1>", "a/first.html": "<h1>Первая</h1><h2>Синтаксис</h2><p>f(x)</p>", "B.HTML": "<p>b</p>"}


def test_container_and_ingest(spark, tmp_path):
    data = book({"PackBlock": zipped({"toc": zlib.compress(TOC.encode())}), "FileStorage": zipped(PAGES)})
    assert set(help_book.Container(data).entities) == {"PackBlock", "FileStorage"}
    (tmp_path / "shquery_ru.hbk").write_bytes(data)
    (tmp_path / "shlang_root.hbk").write_bytes(book({"Other": b"xx"}))
    rows = {r.html_path: r for r in help_book.read_books(spark, str(tmp_path), "8.3").collect()}
    assert len(rows) == 4
    first = rows["a/first.html"]
    assert (first.id, first.domain, first.locale, first.title_ru, first.parent_path) == ("query_lang:a_first.html", "query_lang", "ru", "Первая", "1")
    assert first.syntax == "## Синтаксис\n\nf(x)" and first.platform_version == "8.3"
    assert rows["leaf.html"].text == "# Leaf"


def test_bad_containers():
    with pytest.raises(ValueError):
        help_book.Container(b"short")
    with pytest.raises(ValueError):
        help_book.Container(b"\0" * 64)


def test_toc_records():
    assert help_book.toc_records('{1,{1,0,0,{"Ру","En"},"/root.html"}}')[0][4:] == ("Ру", "En", "root.html")
    assert help_book.toc_records('﻿{1,{"x",0,0,{"ru","x"}},{2,0}}') == []
    assert help_book.page_names([[1, 1, [1, 2, ["ru", "x"], ["en", "y"]], "/d/n.html"]]) == ("x", "y", "d/n.html")
    assert help_book.bracket_values('{1,"a\\"b",{c,-2}}') == [1, 'a\\"b', ["c", -2]]
    with pytest.raises(ValueError):
        help_book.bracket_values("{1,{2}")


def test_reading_order_leaves_cycles_out(spark):
    rows = [("f", 0, 1, 0, 0, "a", "", ""), ("f", 1, 2, 1, 0, "b", "", ""), ("f", 2, 3, 4, 0, "c", "", ""), ("f", 3, 4, 3, 0, "d", "", ""), ("f", 4, 5, 1, 0, "e", "", "")]
    pages = spark.createDataFrame(rows, "file string, " + help_book.PAGES)
    got = help_book.in_reading_order(pages).orderBy("reading_ord").collect()
    assert [(r.block_id, r.depth) for r in got] == [(1, 0), (2, 1), (5, 1)]


def test_methods(spark):
    files = spark.createDataFrame([("CommonModules/М/Ext/Module.bsl", MODULE), ("x/Other.bsl", None)], "path string, content string")
    got = modules.methods(files).orderBy("line_no").collect()
    assert [(r.module, r.name, r.kind) for r in got] == [("М", "Разделить", "method"), ("М", "Внутри", "procedure")]
    assert (got[0].description, got[0].parameters, got[0].return_value) == ("Делит строку.", "Строка - что делить", "Массив")
    row = modules.chunks_of(modules.methods(files), "3.1").where("id = 'bsp:М.Разделить'").first()
    assert row.text.startswith("# М.Разделить\n\nДелит строку.\n\n## Параметры\n\nСтрока - что делить\n\n## Возвращаемое значение") and row.text.endswith("```\n\nМодуль: `М`")
    assert stats.module_stats(modules.methods(files)).first().asDict() == {"modules": 1, "methods": 2, "without_comment": 1}
    assert spark.range(1).select(modules.version(F.lit("<a><Version> 3.1 </Version></a>"))).first()[0] == "3.1"


def test_nested_regions_are_not_public():
    assert modules.public_methods("#Область ПрограммныйИнтерфейс\n#Область В\nФункция А() Экспорт\n#КонецОбласти\n#КонецОбласти") == []


def test_markdown():
    html = "<html><head><title>t</title><style>p{}</style></head><body><h2>A <b>b</b></h2><!-- c --><p>one<p>two <a href=x>link</a><ol><li>x<li>y</ol><table><tr><th>h<td>i<tr><td>1<td>2</table><pre>a\n b</pre>z<br>w</body></html>"
    assert markup.page_markdown(html) == "## A **b**\n\none\n\ntwo link\n1. x\n2. y\n| h | i |\n| --- | --- |\n| 1 | 2 |\n\n```\na\n b\n```\nz\nw"
    assert markup.page_markdown("") == ""


def test_sections():
    got = markup.page_sections("lead\n# Name\n## Syntax\ncall\n## Parameters:\np")
    assert got["body"] == "lead" and got["syntax"] == "## Syntax\ncall" and got["parameters"] == "## Parameters:\np"
    found = markup.behaviour_sections("# T\nlead\n\nlater\n## Параметры:\n a\n\n\n b")
    assert found == {"description": "lead", "parameters": "a\n\nb", "returns": "", "syntax": ""}
    assert markup.semantic_text("# T\nОписание:\nd\nСинтаксис:\ns", "s", "p") == "d\n\ns\n\np"
    assert markup.semantic_text("# only", "", "") == ""


def test_lexical_text(spark):
    rows = chunks.completed(spark.createDataFrame([("1", "bsp", "СтрРазделить", "CommonModules/Общий"), ("2", "x", "", "p")], "id string, domain string, title_ru string, path string"))
    got = [r.lexical_text for r in chunks.with_texts(rows).orderBy("id").collect()]
    assert got == ["СтрРазделить стр разделить CommonModules/Общий common modules общий", ""]


def fold(rows):
    """The merge, row by row."""
    out = {}
    for r in rows:
        key = (r["domain"], r["path"])
        if key not in out:
            out[key] = dict(r)
            continue
        e = out[key]
        if r["locale"] == "ru":
            e["title_ru"] = r["title_ru"] or e["title_ru"]
            if len(r["text"]) > len(e["text"]):
                e["text"] = r["text"]
        else:
            e["title_en"] = r["title_en"] or e["title_en"]
        e["syntax"] = r["syntax"] or e["syntax"]
    return out


def test_languages_merge_like_the_fold(spark):
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["", "a", "bb", "ccc", "dddd"])
    rows = [{"chunk_ord": i, "id": str(i), "domain": "d", "path": rng.choice("xyz"), "locale": rng.choice(["ru", "en"]), "title_ru": word(), "title_en": word(), "text": word(), "syntax": word()} for i in range(60)]
    schema = "chunk_ord bigint, id string, domain string, path string, locale string, title_ru string, title_en string, text string, syntax string"
    frame = chunks.completed(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    got = {(r.domain, r.path): r for r in chunks.merged_languages(frame).collect()}
    for key, e in fold(rows).items():
        assert all(got[key][c] == e[c] for c in ("id", "title_ru", "title_en", "text", "syntax"))


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "domain": "bsp", "extra": 1}\n\n{"id": "2", "domain": "x", "title_ru": "Т"}\n', encoding="utf-8")
    rows = jsonl.read_chunks(spark, str(tmp_path / "a.jsonl"))
    assert rows.count() == 2 and rows.where("id = '1'").first().title_ru == ""
    new = rows.where("id = '1'").withColumn("id", F.lit("9"))
    merged = chunks.replaced_domain(rows, new, "bsp")
    jsonl.write_chunks(merged, str(tmp_path / "out"))
    assert {r.id for r in jsonl.read_chunks(spark, str(tmp_path / "out")).collect()} == {"2", "9"}
    jsonl.write_index_meta(spark, str(tmp_path / "meta"), 2, "2020-01-01", "8.3", "hashing", "m", 64)
    assert jsonl.read_index_meta(spark, str(tmp_path / "meta")).first().indexed_count == 2


CODE = 'А = 1;\nЗапрос = Новый Запрос("ВЫБРАТЬ\nТовары.Ссылка ИЗ Справочник.Товары");\n'


def test_query_texts_and_snippets(spark):
    files = spark.createDataFrame([("l", "a.bsl", CODE), ("l", "b.bsl", "x" * 60), ("l", "c.bsl", "short")], "label string, path string, content string")
    got = {r.id: r for r in examples.snippets(files).collect()}
    assert set(got) == {"l:a.bsl:0", "l:a.bsl:1", "l:b.bsl:0"}
    assert got["l:a.bsl:0"].query_text == "ВЫБРАТЬ\nТовары.Ссылка ИЗ Справочник.Товары" and got["l:a.bsl:0"].start_line == 2
    assert got["l:b.bsl:0"].code == "x" * 60


def test_links_and_topics(spark):
    code = spark.createDataFrame([(1, "e1", "выборка товары склад", "", ""), (2, "e2", "ничего", "", "")], "ex_ord bigint, id string, code string, query_text string, summary string")
    topics = spark.createDataFrame([(1, "t1", "Товары Склад"), (2, "t2", "Товары Прочее Склад"), (3, "t3", "и в")], "topic_ord bigint, id string, title string")
    linked = examples.linked_by_words(code, topics)
    assert [(r.ex_ord, r.topic_ids, r.relevance) for r in linked.collect()] == [(1, ["t1", "t2"], 1.0)]
    assert examples.of_topic(linked, "t2").count() == 1
    assert {r.id: r.examples for r in examples.topics_with_examples(topics, linked).collect()} == {"t1": ["e1"], "t2": ["e1"], "t3": []}
    assert [r.ex_ord for r in examples.searched(code, "товары склад").collect()] == [1]


def test_scans_keep_what_is_unchanged(spark):
    files = spark.createDataFrame([("l", "a.bsl", CODE), ("l", "b.bsl", "y" * 60)], "label string, path string, content string")
    none = spark.createDataFrame([], "path string, hash string")
    first, seen = merged_scan(files, none, examples.snippets(files).limit(0))
    again, seen2 = merged_scan(files.where("path = 'b.bsl'").withColumn("content", F.lit("z" * 70)), seen, first)
    assert first.count() == again.count() == 3 and seen2.count() == 2
    assert again.where("module_path = 'b.bsl'").first().code == "z" * 70


def test_stream_reads_new_files_once(spark, tmp_path):
    source = tmp_path / "src"
    (source / "deep").mkdir(parents=True)
    (source / "a.bsl").write_text(CODE, encoding="utf-8")
    for n in (2, 3):
        watch(spark, str(source), "l", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (source / "deep" / "b.os").write_text("q" * 80, encoding="utf-8")


def test_readiness(spark):
    schema = "export_there boolean, meta_there boolean, index_there boolean, index_readable boolean, wants_vector_index boolean, vector_index_built boolean, bsp_expected boolean, embedding_matches boolean, n_export bigint, n_indexed bigint, n_bsp bigint"
    codes = lambda *row: [r.code for r in stats.readiness_issues(spark.createDataFrame([row], schema)).collect()]
    assert codes(True, True, True, True, True, True, True, True, 300, 300, 1) == []
    assert codes(False, False, False, True, True, None, False, True, 0, 0, 0) == ["export_missing"]
    assert codes(True, True, False, True, True, None, False, True, 10, 0, 0) == ["index_missing", "index_broken"]
    assert codes(True, True, True, True, True, False, True, False, 300, 300, 0) == ["embedding_mismatch", "vector_index_missing", "bsp_not_indexed"]
    assert codes(True, True, True, True, True, None, False, True, 300, 100, 0) == ["partial_index", "not_ready"]


def test_links_by_a_model(spark):
    from lodestone.sources import chat

    class Echo:  # local, so that it is sent by value
        def answer(self, prompt):
            return '```json\n{"topic_ids": ["t1"], "relevance": 0.9, "summary": "s"}\n```' if "выборка" in prompt else "no idea"

    code = spark.createDataFrame([(1, "e1", "выборка товары", ""), (2, "e2", "ничего", "q")], "ex_ord bigint, id string, code string, query_text string")
    topics = spark.createDataFrame([(1, "t1", "Товары", "d")], "topic_ord bigint, id string, title string, domain string")
    assert [(r.id, r.topic_ids, r.relevance, r.summary) for r in chat.linked_by_model(code, topics, Echo()).collect()] == [("e1", ["t1"], 0.9, "s")]
    answers = spark.createDataFrame([(' {"a": 1} ',), ("x ```\n[1]\n``` y",), ("```json\n```",)], "x string")
    assert [r[0] for r in answers.select(chat.json_text(F.col("x"))).collect()] == ['{"a": 1}', "[1]", ""]


def test_markdown_of_odd_pages():
    nested = "<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>"
    assert markup.page_markdown(nested) == "| a b | b | c |\n| --- | --- | --- |\n| b |"
    assert markup.page_markdown("<div>x<script>no</script> <em>y</em></div><ul><li>one <b>two</b> <a>three</a><ul><li>four</li></ul></ul>") == "x y- one **two** threefour"
    assert markup.page_markdown("<p>open<h3>next") == "open\n\n### next"


def test_entries_are_found_by_the_ends_of_names(spark):
    pages = spark.createDataFrame([("f", "x/first.html"), ("f", "x/a-very-long-name.html"), ("f", "none.html"), ("f", "")], "file string, html_path string")
    entries = spark.createDataFrame([("f", "y/zfirst.html", ""), ("f", "afirst.html", ""), ("f", "q/some-a-very-long-name.html", ""), ("g", "none.html", "")], "file string, entry string, html string")
    got = {r.html_path: r.entry for r in help_book.resolved_entries(pages, entries).collect()}
    assert got == {"x/first.html": "afirst.html", "x/a-very-long-name.html": "q/some-a-very-long-name.html", "none.html": None, "": None}
