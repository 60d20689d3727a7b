"""Quality rules with risk-controlled thresholds.

Each rule is a rate of a document, and a document breaks it above a cutoff. Labelled documents that nothing else was
fitted on choose the cutoffs of all rules together, per stratum ("learn, then test"). They are dealt into two parts by a hash of
their ids. On one part a path is grown: of all rules and cutoffs, the one that adds most goes on next, where what it adds is
the share of bad documents that it rejects and no earlier one did, less ``COST`` times that of the good ones, until nothing
adds. The other part tests the path from its beginning: a step is certified if an exact binomial test shows that all
rules so far together reject at most ``risk`` of the good documents, and the first failure ends the walk (a fixed sequence, so
its length costs no correction). The level is ``delta`` over the strata that have labels enough to certify anything
(Bonferroni). So, with probability ``1 - delta`` over the labelled rows, the rules together reject at most ``risk`` of
the good documents of every stratum. Among the certified steps the one with the largest gain is taken, the first of equals.
Only documents that pass the base rules count, as the others go anyway. A stratum with too few labels to certify
anything rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import broadcast_if_small, materialized, need, tuned
from lodestone.llm.wordhash import run_hashes, word_codes

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SPACES, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
#: What rejecting a share of the good documents weighs against rejecting the same share of the bad ones.
COST = 10
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]

#: Rules: a rate of a document's counts (numerator, denominator) and the cutoffs tried, loosest first.
_PERCENT = [95, 90, 80, 70, 60, 50, 45, 40, 35, 30, 25, 20, 17, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("100 * n_symbols", "word_chars", _PERCENT),
    "duplicate lines": ("100 * n_dup_lines", "n_lines", _PERCENT),
    "repeated windows": ("100 * n_repeat_words", "n_words", _PERCENT),
    "capitals": ("100 * n_upper", "word_chars", _PERCENT),
    "digits": ("100 * n_digits", "word_chars", _PERCENT),
    "marks": ("100 * n_marks", "n_words", [200, 150, 120, 100, *_PERCENT[1:]]),
    "long words": ("word_chars", "n_words", [60, 50, 40, 30, 25, 20, 18, 16, 15, 14, 13, 12, 11, 10, 9, 8]),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    hashes = run_hashes(word_codes(words), window)
    ranked = np.sort(hashes)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    # Equal runs have equal hashes; which of the equal hashes are equal runs, the words decide.
    again = np.nonzero(np.isin(hashes, ranked[1:][ranked[1:] == ranked[:-1]]))[0].tolist()
    seen: dict[tuple, list[int]] = {}
    for at in again:
        seen.setdefault(tuple(words[at : at + window]), []).append(at)
    inside = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(inside, places, 1)
            np.add.at(inside, [p + window for p in places], -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """The counts (``COUNTS``) of one UTF-8 text; all 0 for null."""
    if not text:
        return (0,) * len(COUNTS)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    without = lambda drop: len(text) - len(text.translate(None, drop))
    return (
        len(words), len(text.translate(None, SPACES + _CONTINUATION)), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"0123456789"), without(b"!?"),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts(texts: pa.Array) -> pa.Array:
    """Struct column of the counts of a string column; one pass over the bytes."""
    rows = [counts_of(x) for x in texts.cast(pa.binary()).to_pylist()]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(COUNTS), COUNTS)


def stratum_of(column: Column) -> Column:
    """A null stratum is the stratum ''."""
    return F.coalesce(column.cast("string"), F.lit(""))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for X binomial with n draws of probability p, summed exactly."""
    if k >= n or p <= 0:
        return 1.0
    log_term = n * math.log1p(-p)
    odds, terms = math.log(p) - math.log1p(-p), [log_term]
    for x in range(1, k + 1):
        log_term += math.log(n - x + 1) - math.log(x) + odds
        terms.append(log_term)
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def chosen_cutoff(grid: list[float], good: list[int], bad: list[int], risk: float, level: float) -> float | None:
    """The cutoff of the largest gain among those certified, loosest first; None if there is none.

    good[i] (bad[i]) is the number of good (bad) documents whose rate is above exactly i cutoffs.
    """
    n_good, n_bad = sum(good), sum(bad)
    best, choice = 0.0, None
    for at, cutoff in enumerate(grid):  # a rate above it is above all the tighter ones too
        false, true = sum(good[len(grid) - at :]), sum(bad[len(grid) - at :])
        if not n_good or binomial_tail(n_good, false, risk) > level:
            break
        gain = true / max(n_bad, 1) - COST * false / n_good
        if gain > best + 1e-12:
            best, choice = gain, float(cutoff)
    return choice


def _rate(rule: str) -> Column:
    """A rule's rate as a column over the counts; 0 without words or lines."""
    over, under, _ = RULES[rule]
    return F.coalesce(F.expr(f"try_divide({over}, {under})"), F.lit(0)).cast("double")


def _n_broken(rule: str) -> Column:
    """How many of a rule's cutoffs the rate is above."""
    rate = _rate(rule)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in RULES[rule][2]]), lambda cutoff: rate > cutoff))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _broken() -> Column:
    """The rules broken, given a map column ``cutoffs`` (null: none is on)."""
    return F.array_compact(F.array(*[F.when(_rate(rule) > F.col("cutoffs")[rule], F.lit(rule)) for rule in RULES]))


#: Stands for a rule that is off: more than any number of cutoffs.
OFF = 1 << 20


def grown(alive: dict[tuple[str, int, bool], int], n_good: int, n_bad: int) -> tuple[str, int] | None:
    """(rule, how many cutoffs of its grid may be broken) that adds most, the loosest of equals; None if none adds.

    alive: of the documents not rejected so far, how many break how many of a rule's cutoffs: by (rule, broken, good).
    """
    best, choice = 1e-12, None
    for rule, (_, _, grid) in RULES.items():
        for most in range(len(grid) - 1, -1, -1):  # who breaks more than so many of the tightest cutoffs breaks the next looser one
            false, true = (sum(alive.get((rule, n, good), 0) for n in range(most + 1, len(grid) + 1)) for good in (True, False))
            gain = true / max(n_bad, 1) - COST * false / max(n_good, 1)
            if gain > best + 1e-12:
                best, choice = gain, (rule, most)
    return choice


def certifiable(n_good: dict[str, int], risk: float, delta: float) -> tuple[set[str], float]:
    """The strata with good documents enough to certify that none rejected means a risk below ``risk``, and the level for each."""
    strata = set(n_good)
    while strata:
        level = delta / len(strata)
        enough = {x for x in strata if binomial_tail(n_good[x], 0, risk) <= level}
        if enough == strata:
            return strata, level
        strata = enough
    return set(), delta


def thresholds(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff double) for the rules that are on.

    labels: (id, label): 1 is good, 0 is bad, null is no label. An id labelled both ways counts as good. All labelled
    rows take part; the driver gets counts by stratum, rule and cutoff only.
    """
    spark = rows.sparkSession
    marks = need(labels, id_col, label_col).where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("good"))
    known = rows.where(~_base_failed()).join(marks, "id")
    broken = {rule: f"broken{i}" for i, rule in enumerate(RULES)}
    vectors = known.select("stratum", (F.col("good") == 1).alias("good"), (F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(2)) == 1).alias("testing"), *[_n_broken(r).alias(c) for r, c in broken.items()])
    vectors = materialized(vectors.groupBy(*vectors.columns).agg(F.count(F.lit(1)).alias("n")), "labelled-rates")
    sizes = {(r.stratum, r.good, r.testing): r.n for r in vectors.groupBy("stratum", "good", "testing").agg(F.sum("n").alias("n")).collect()}
    strata, level = certifiable({x: sizes.get((x, True, True), 0) for x, _, _ in sizes}, risk, delta)

    paths: dict[str, list[dict[str, int]]] = {x: [] for x in strata}
    growing = set(strata)
    while growing:  # at most a step for each cutoff, and each rejects more
        now = [(x, *[(paths[x][-1] if paths[x] else {}).get(rule, OFF) for rule in RULES]) for x in sorted(growing)]
        bounds = broadcast_if_small(spark.createDataFrame(now, "stratum string, " + ", ".join(f"at{i} int" for i in range(len(RULES)))))
        alive = vectors.where("not testing").join(bounds, "stratum").where(" and ".join(f"broken{i} <= at{i}" for i in range(len(RULES))))
        each = F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(c).alias("broken")) for rule, c in broken.items()]))
        tally: dict[str, dict] = {}
        for r in alive.select("stratum", "good", "n", each).groupBy("stratum", "rule", "broken", "good").agg(F.sum("n").alias("n")).collect():
            tally.setdefault(r.stratum, {})[r.rule, r.broken, r.good] = r.n
        for x in sorted(growing):
            step = grown(tally.get(x, {}), sizes.get((x, True, False), 0), sizes.get((x, False, False), 0))
            if step is None:
                growing.discard(x)
            else:
                paths[x].append((paths[x][-1] if paths[x] else {}) | {step[0]: step[1]})

    found = []
    steps = [(x, at, *[config.get(rule, OFF) for rule in RULES]) for x, path in paths.items() for at, config in enumerate(path)]
    if steps:
        bounds = broadcast_if_small(spark.createDataFrame(steps, "stratum string, step int, " + ", ".join(f"at{i} int" for i in range(len(RULES)))))
        beyond = " or ".join(f"broken{i} > at{i}" for i in range(len(RULES)))
        counted = vectors.where("testing").join(bounds, "stratum").groupBy("stratum", "step", "good").agg(F.sum(F.when(F.expr(beyond), F.col("n")).otherwise(0)).alias("n")).collect()
        rejected = {(r.stratum, r.step, r.good): r.n for r in counted}
        for x, path in paths.items():
            # As ``chosen_cutoff`` wants them: how many are rejected by exactly i of the path's steps. Each step rejects what the one before does.
            sums = {good: [0, *[rejected.get((x, at, good), 0) for at in range(len(path))], sizes.get((x, good, True), 0)] for good in (True, False)}
            exactly = [[after - before for before, after in zip(s, s[1:], strict=False)][::-1] for s in (sums[True], sums[False])]
            choice = chosen_cutoff(list(range(len(path))), *exactly, risk, level)
            if choice is not None:
                found += [(x, rule, float(RULES[rule][2][-1 - most])) for rule, most in path[int(choice)].items()]
    return spark.createDataFrame(found, "stratum string, rule string, cutoff double")


def _with_cutoffs(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    by = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    return rows.join(broadcast_if_small(by), "stratum", "left")


def measured(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """(id, stratum, the counts) of each row, written once."""
    rows = need(docs, id_col, text_col, stratum_col).select(F.col(id_col).alias("id"), stratum_of(F.col(stratum_col)).alias("stratum"), counts(F.col(text_col)).alias("c"))
    return materialized(rows.select("id", "stratum", "c.*"), "measured")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **how) -> DataFrame:
    """id, the counts, base_failed, broken (array of the rules broken) and kept, a row for each row of ``docs``.

    Null and empty texts have counts of 0 and fail the base rules (fewer than 10 words, or over 20 % of the words in
    repeated 5-word windows). Rows with a null id or no label are judged but choose no cutoff. Without labels only
    the base rules apply. Repeated rows are judged alike. Other columns are not read.
    """
    tuned(docs.sparkSession)
    rows = measured(docs, id_col, text_col, stratum_col)
    out = _with_cutoffs(rows, thresholds(rows, labels, id_col, **how)).withColumn("base_failed", _base_failed()).withColumn("broken", _broken())
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "broken", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **how) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns.

    The texts are read a second time instead of being shuffled to meet their verdicts.
    """
    tuned(docs.sparkSession)
    cutoffs = materialized(thresholds(measured(docs, id_col, text_col, stratum_col), labels, id_col, **how), "cutoffs")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), stratum_of(docs[stratum_col]).alias("stratum"), counts(docs[text_col]).alias("c"))
    kept = _with_cutoffs(rows.select("row", "stratum", "c.*"), cutoffs).where(~_base_failed() & (F.size(_broken()) == 0))
    return kept.select("row.*")
