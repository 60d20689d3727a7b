import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import scoring, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "words"), [("СтрРазделить", "стр разделить"), ("StrSplit", "str split"), ("Модуль.СтрокаВМассив", "модуль строка в массив"), ("split", "split"), ("getPath", "path"), ("", "")])
def test_split_identifier(spark, name, words):
    assert value(spark, text.split_identifier(F.lit(name))) == words


@pytest.mark.parametrize(("token", "stem"), [("строками", "строк"), ("массива", "массив"), ("дом", "дом"), ("яма", "яма"), ("описание", "описани")])
def test_stem(spark, token, stem):
    assert value(spark, text.stem(F.lit(token))) == stem


def python_stem(token):
    return next((token[: -len(s)] for s in text.SUFFIXES if token.endswith(s) and len(token) - len(s) >= 3), token)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("абвгеийоуыьюямхс", min_size=1, max_size=9), min_size=1, max_size=60))
def test_stem_is_the_loop_over_suffixes(spark, words):
    got = value(spark, F.transform(F.array(*map(F.lit, words)), text.stem))
    assert got == [python_stem(w) for w in words]


@pytest.mark.parametrize(("a", "b", "related"), [("строку", "строка", True), ("раздел", "разделить", True), ("ab", "abc", False), ("строку", "массив", False), ("я", "я", True)])
def test_related(spark, a, b, related):
    assert value(spark, text.related(F.lit(a), F.lit(b))) is related


def test_transformation_queries(spark):
    assert value(spark, text.expanded_query(F.lit("строку в массив"))).endswith("разделить строку")
    assert value(spark, text.expanded_query(F.lit("split"))) == "split"
    assert value(spark, text.is_transformation(F.lit("строку массив"))) is False


def test_excerpts(spark):
    long = "a" * 600 + "Needle" + "b" * 600
    got = value(spark, text.excerpt(F.lit(long), F.array(F.lit("needle")), 500))
    assert (got.begin, got.end) == (350, 850) and got.excerpt == "..." + long[350:850] + "..."
    assert value(spark, text.excerpt(F.lit("short"), F.array(F.lit("x")), 500)).asDict() == {"excerpt": "short", "begin": 0, "end": 5}
    assert value(spark, text.excerpt(F.lit(long), F.array(F.lit("zzz")), 500)).excerpt == long[:500] + "..."
    assert value(spark, text.excerpt(F.lit(None).cast("string"), F.array(F.lit("x")), 500)).excerpt == ""


def test_matched_terms_keep_query_order(spark):
    assert value(spark, text.matched_terms(F.lit("b a b c"), F.lit("A, c; b"))) == ["b", "a", "c"]


def test_bonuses(spark):
    assert value(spark, scoring.title_bonus(F.lit("СтрРазделить"), F.lit("СтрРазделить стр разделить"))) == pytest.approx(0.05)
    assert value(spark, scoring.title_bonus(F.lit(""), F.lit("x"))) == 0
    bonus = scoring.intent_bonus(F.lit("строку в массив"), F.lit("Разделить строку, получить массив"), F.lit("method"), F.lit("platform_api"))
    assert value(spark, bonus) == pytest.approx(0.1)


def test_highlight(spark):
    assert value(spark, text.highlighted(F.lit("Foo foobar"), ["foo", "foobar"])) == "<mark>Foo</mark> <mark>foobar</mark>"


def test_settings_are_checked():
    with pytest.raises(ValueError, match="rrf_k"):
        scoring.SearchSettings(rrf_k=0)


def test_words_are_compared_by_their_stems(spark):
    words = ["a", "ab", "ая", "дом", "дома", "домами", "домик", "до", "слово", "словами", "слов", "strsplit", "str", "st", "ями", "массивами", "массив7", "7", "77"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    stem = lambda t: F.regexp_replace(t, text.STEM_PATTERN, "$1")
    over = lambda a, b: (F.length(a) >= 3) & (F.length(b) >= 3) & (a.startswith(b) | b.startswith(a))
    a, b = F.col("a"), F.col("b")
    plain = (a == b) | over(a, b) | (stem(a) == stem(b)) | over(stem(a), stem(b))
    assert rows.where((text.related(a, b) != plain) | (text.stem(a) != stem(a))).count() == 0


def test_a_title_is_split_once_however_many_words_are_asked(spark):
    from lodestone.plans import catalog

    plan = catalog.QUERIES["title_bonus"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "regexp_extract_all" not in above and "regexp_extract_all" in below
