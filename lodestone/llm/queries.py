"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, hmm, linededup, merkle, periodic, pieces, quality, secret_scan, simhash, substring, toxicity, url_filter, warc
from lodestone.llm.common import id_crc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0))
), sizes AS (SELECT DISTINCT size FROM bw), dw AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hit AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS list FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.samples(table(spark, sf_dir, "documents"), k=3, digest=True)
    return found.withColumnRenamed("ids", "ids_sha256")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws("-", s["begin"], s["end"]))
    return found.select("doc_id", "n_words", "n_repeated", F.size("spans").cast("bigint").alias("n_passages"), F.array_join(spans, ",").alias("passages"), "n_links", "linked_to", "class_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken_rules"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
k AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM k)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 5, top_levels: int = 4) -> str:
    """The same tree for at most 16^``levels`` documents of a source and 16^``top_levels`` sources."""
    field = lambda c, cast=True: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {f'CAST({c} AS VARCHAR)' if cast else c}, '-')"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = [field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    ctes = [
        f"leaves AS (SELECT doc_id, source, sha256({' || '.join([*fields, field('text', False)])}) AS leaf, sha256({' || '.join([*fields, field(lowered, False)])}) AS other, {CRC_SQL.format('doc_id')} % 5 = 0 AS tampered FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        "s0 AS (SELECT source AS grp, pos, n, leaf AS d FROM a0)",
    ]

    def tower(name: str, count: int) -> None:
        for k in range(count):
            beside = "coalesce(string_agg(d, '') OVER (PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN {}), '')"
            before, after = beside.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), beside.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            ctes.append(f"{name}p{k} AS (SELECT grp, pos, n > 1 AS more, {before} AS b, {after} AS f FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS (SELECT grp, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {name}{k} GROUP BY grp, pos // 16)")

    tower("s", levels)
    ctes.append(f"t0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, d, grp AS source FROM s{levels})")
    tower("t", top_levels)
    ctes.append(f"f0 AS (SELECT a0.*, t0.pos AS top, t0.d AS subroot, (SELECT d FROM t{top_levels}) AS root, '' AS proof, CASE WHEN tampered THEN other ELSE leaf END AS folded FROM a0 JOIN t0 ON a0.source IS NOT DISTINCT FROM t0.source)")
    step = 0
    for name, count, place, same in (("s", levels, "pos", "p.grp IS NOT DISTINCT FROM f.source"), ("t", top_levels, "top", "true")):
        for k in range(count):
            ctes.append(f"f{step + 1} AS (SELECT f.* REPLACE (CASE WHEN more THEN proof || b || p.f ELSE proof END AS proof, CASE WHEN more THEN sha256(b || folded || p.f) ELSE folded END AS folded) FROM f{step} f JOIN {name}p{k} p ON {same} AND p.pos = f.{place} // {16**k})")
            step += 1
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{step}"


def _crc_table() -> list[int]:
    """Of each byte, what eight steps of the CRC-32 polynomial make of it."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


#: crc32 of a number's decimal text, with the number's column to fill in.
CRC_SQL = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, list_extract(CAST(" + str(_crc_table()) + " AS BIGINT[]), (xor(c, b) & 255) + 1))), 4294967295)"


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"), secret_scan.labelled_samples(spark))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    h = F.when(F.col("doc_id").isNotNull(), id_crc(F.col("doc_id")))
    found = periodic.periodic_runs(docs.select("doc_id", periodic.with_planted(F.col("text"), h).alias("text")), digest=True)
    exponent = F.floor(1000 * F.col("length") / F.col("period")).cast("bigint")
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Words that stand again q words later, by their trigrams: stretches of such places are runs, and a run has such a stretch.
OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {CRC_SQL.format('doc_id')} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
x AS (SELECT row, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
t AS (SELECT row, i, word || ' ' || lead(word, 1) OVER (PARTITION BY row ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY row ORDER BY i) AS tri FROM x),
pair AS (SELECT a.row, a.i, b.i - a.i AS q FROM t a JOIN t b ON a.row = b.row AND a.tri = b.tri AND b.i > a.i),
island AS (SELECT row, q, min(i) AS start, count(*) + 2 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pair) GROUP BY row, q, island),
r AS (SELECT row, start, length, min(q) AS q FROM island WHERE length >= greatest(6, 4 * q) GROUP BY row, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY length DESC, start, q) AS k FROM r),
lines AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST((1000 * length) // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (row) LEFT JOIN lines USING (row) LEFT JOIN kept USING (row)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_simhash": op2_simhash,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_line_dedup": op5_line_dedup,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_quality": op8_quality,
        "op9_hmm": op9_hmm,
        "op10_warc": op10_warc,
        "op11_merkle": op11_merkle,
        "op12_secret_scan": op12_secret_scan,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op10_warc": OP10_SQL, "op11_merkle": _merkle_sql(), "op13_periodic_runs": OP13_SQL}
