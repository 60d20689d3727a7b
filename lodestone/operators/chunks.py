"""Chunks: the rows that are indexed, their derived texts, and merging of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.markup import semantic
from lodestone.functions.text import split_identifier

FIELDS = ["id", "domain", "title_ru", "title_en", "path", "parent_path", "entity_kind", "platform_version", "hbk_source", "locale", "text", "syntax", "parameters", "signature", "html_path"]
SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def completed(rows: DataFrame) -> DataFrame:
    """All fields of a chunk, absent and null ones as ''."""
    return rows.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in rows.columns else F.lit("").alias(f) for f in FIELDS], *[c for c in rows.columns if c not in FIELDS])


def lexical_text() -> Column:
    """Titles and, for library chunks, paths, each followed by its words."""
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("title_ru", "title_en")] + [F.when((F.col("domain") == "bsp") & (F.col("path") != ""), F.col("path"))]
    parts = [x for name in named for x in (name, F.nullif(split_identifier(name), F.lit("")))]
    return F.trim(F.concat_ws(" ", *parts))


def search_text(lexical: Column, meaning: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.nullif(lexical, F.lit("")), F.nullif(meaning, F.lit(""))))


def with_texts(chunks: DataFrame) -> DataFrame:
    """Chunks with lexical_text, semantic_text and search_text; those that are there and not blank stay."""
    given = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in chunks.columns else F.lit(None).cast("string")
    rows = chunks.withColumn("lexical_text", F.coalesce(given("lexical_text"), lexical_text()))
    rows = rows.withColumn("semantic_text", F.coalesce(given("semantic_text"), semantic(F.col("text"), F.col("syntax"), F.col("parameters"))))
    return rows.withColumn("search_text", F.coalesce(given("search_text"), search_text(F.col("lexical_text"), F.col("semantic_text"))))


def entity_kind(path: Column, title: Column) -> Column:
    """Kind of an entity from its page's path, else from query keywords in the title."""
    low = F.lower(path)
    folder = lambda name: low.contains(f"/{name}/") | low.startswith(f"{name}/")
    keywords = F.upper(title).rlike("SELECT|JOIN|WHERE|GROUP|UNION")
    return (
        F.when(folder("methods"), "method").when(folder("properties"), "property").when(low.contains("/constructors/") | low.contains("ctor_"), "constructor")
        .when(low.contains("/enum"), "enum").when(low.contains("/events/"), "event").when(keywords, "query_construct").when(low.endswith(".html"), "page").otherwise("topic")
    )


def chunk_id(domain: Column, place: Column) -> Column:
    return F.concat(domain, F.lit(":"), F.translate(place, "/\\", "__"))


def merged_languages(chunks: DataFrame, order: str = "chunk_ord") -> DataFrame:
    """One row for each domain and page. The first row gives the identity; later Russian rows replace the Russian title,
    and the text by a longer one, later other rows replace the English title; the last syntax and parameters stay.

    An ordered fold, written as aggregates over (value, order): the longest text of the first and the later Russian rows
    wins, the earliest of equals.
    """
    key = F.concat(F.col("domain"), F.lit(":"), F.coalesce(F.nullif("path", F.lit("")), F.nullif("html_path", F.lit("")), F.col("id")))
    rows = chunks.withColumn("_key", key).withColumn("_first", F.row_number().over(Window.partitionBy("_key").orderBy(order)) == 1)
    ru = F.col("locale") == "ru"
    last = lambda c, when: F.max_by(F.when(when & (F.col(c) != ""), F.col(c)), F.when(when & (F.col(c) != ""), F.col(order)))
    first = lambda c: F.min_by(c, order)
    changed = {
        "title_ru": F.coalesce(last("title_ru", ru & ~F.col("_first")), first("title_ru")),
        "title_en": F.coalesce(last("title_en", ~ru & ~F.col("_first")), first("title_en")),
        "text": F.max_by(F.when(ru | F.col("_first"), F.col("text")), F.when(ru | F.col("_first"), F.struct(F.length("text"), -F.col(order)))),
        "syntax": F.coalesce(last("syntax", F.lit(True)), first("syntax")),
        "parameters": F.coalesce(last("parameters", F.lit(True)), first("parameters")),
    }
    return rows.groupBy("_key").agg(F.min(order).alias(order), *[changed.get(f, first(f)).alias(f) for f in FIELDS]).drop("_key")


def replaced_domain(old: DataFrame, new: DataFrame, domain: str) -> DataFrame:
    """``old`` without one domain's rows, and ``new``."""
    return old.where(~F.col("domain").eqNullSafe(F.lit(domain))).unionByName(new)


def first_by_id(chunks: DataFrame, order: str = "chunk_ord") -> DataFrame:
    """The first row of each id."""
    by = Window.partitionBy("id").orderBy(order)
    return chunks.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def topic(chunks: DataFrame, topic_id: str) -> DataFrame:
    """The first chunk with an id; no row if there is none."""
    return chunks.where(F.col("id") == topic_id).orderBy("chunk_ord").limit(1)


def write_index(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Chunks as Parquet, a folder for each domain, so that a search in one domain reads that folder only."""
    chunks.write.mode(mode).partitionBy("domain").parquet(path)


#: Chunks of a slice, about, and slices at most; ids up to which a fetch goes by slices, and up to which they stand in its filter.
SLICE_ROWS, MOST_SLICES, FETCHED, LITERALS = 4096, 4096, 50_000, 1000


def slice_of(id_: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(slices)).cast("int")


def slices_for(n: int) -> int:
    """A power of two."""
    slices = 1
    while slices < MOST_SLICES and slices * SLICE_ROWS < n:
        slices *= 2
    return slices


def write_sliced(chunks: DataFrame, path: str, slices: int) -> None:
    """Like ``write_index``; a domain's chunks in slices by a hash of the id, each sorted by id, so that an id says where its row is."""
    dealt = chunks.withColumn("slice", slice_of(F.col("id"), slices)).repartition("domain", "slice").sortWithinPartitions("domain", "slice", "id")
    dealt.write.mode("overwrite").partitionBy("domain", "slice").parquet(path)


def fetched(chunks: DataFrame, wanted: DataFrame, slices: int) -> DataFrame:
    """The chunks (written by ``write_sliced``) of the ids in ``wanted``, once each. The scan reads the slices of these ids and of them the
    row groups that can hold them; for more than ``FETCHED`` ids it reads everything and joins."""
    ids = wanted.select("id").distinct()
    few = ids.select("id", slice_of(F.col("id"), slices).alias("slice")).limit(FETCHED + 1).collect()
    rows = chunks
    if len(few) <= FETCHED:
        rows = rows.where(F.col("slice").isin(sorted({r.slice for r in few})))
    if len(few) <= LITERALS:
        return rows.where(F.col("id").isin(sorted(r.id for r in few))).drop("slice")
    return rows.drop("slice").join(ids, "id", "left_semi")
