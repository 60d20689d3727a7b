"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a text: densities of two lexicons (fixed insults, and terms learned from labelled texts), how near
second-person words the hits stand, and rates of capitals, punctuation and obfuscation. Learned terms are words and
word beginnings, so inflected forms count.

The labelled rows used are bounded (``max_rows``; those of the smallest hashed ids) and dealt into three parts by
their hash: one for the lexicon, one for the trees and one for the calibration, so that no part judges
what it was learned from. Every text is then scored whole, in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.boosting import Isotonic, Trees, fitted
from lodestone.llm.common import id_crc, materialized, need, tuned
from lodestone.llm.wordhash import alnum_words

#: Insults in four languages.
INSULTS = """
idiot idiots moron morons stupid dumb fool loser losers pathetic scum trash garbage worthless disgusting clown jerk creep freak ugly vermin filth
imbecile cretin brainless coward liar
dumm dummkopf trottel depp abschaum versager widerlich
imbécile crétin stupide nul ordure minable abruti
idiota estúpido estúpida tonto imbécil basura inútil asqueroso
""".split()
#: Words that address the reader.
SECOND_PERSON = """
you your yours yourself youre du dich dir dein deine deinen euch euer ihr sie tu toi te ton ta tes vous votre vos ti tú usted ustedes vosotros
""".split()
PREFIXES = (3, 4, 5, 6)
NEAR = 5
MAX_TERMS = 1000
FEATURES = ["log_words", "fixed", "fixed_hits", "learned", "learned_hits", "weight", "top_weight", "terms", "addressed", "near_second", "capitals", "shouted", "exclaims", "asks", "repeated_marks", "digits_inside", "signs_inside", "stretched", "spelled_out"]


def terms_of(word: bytes) -> Iterator[bytes]:
    """The word itself, and its beginnings with a mark."""
    yield word
    text = word.decode(errors="replace")
    for n in PREFIXES:
        if len(text) > n:
            yield text[:n].encode() + b"*"


def _term_counts(flush_at: int = 500_000):
    def rows(counts: dict[bytes, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t.decode(errors="replace") for t in counts], pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["term", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in {t for w in set(alnum_words(text)) for t in terms_of(w)}:
                    counts.setdefault(term, [0, 0])[toxic] += 1
            if len(counts) > flush_at:
                yield rows(counts)
                counts = {}
        yield rows(counts)

    return run


def learned_lexicon(texts: DataFrame) -> dict[bytes, float]:
    """The ``MAX_TERMS`` terms that tell toxic (text, toxic int) from clean most surely, with their log-odds."""
    sums = texts.groupBy().agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_toxic, n_clean = sums[0] or 0, (sums[1] or 0) - (sums[0] or 0)
    counted = texts.mapInArrow(_term_counts(), "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t >= 4")
    odds = F.log((F.col("t") + 0.5) / (n_toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (n_clean - F.col("c") + 0.5))
    sure = counted.withColumn("odds", odds).withColumn("sure", F.col("odds") / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))).where("odds > 2 and sure > 3.5")
    return {r.term.encode(): r.odds for r in sure.orderBy(F.desc("sure"), "term").limit(MAX_TERMS).select("term", "odds").collect()}


class Weights(dict):
    """Weight of each word: its term of the largest log-odds, 0 without one. Filled as words come up, in bounded size."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = max((self.lexicon[t] for t in terms_of(word) if t in self.lexicon), default=0.0)
        return out


_INSIDE_DIGITS, _INSIDE_SIGNS = re.compile(rb"[A-Za-z][0-9]+[A-Za-z]"), re.compile(rb"[A-Za-z][@$*#%!|]+[A-Za-z]")
_STRETCHED, _SPELLED = re.compile(rb"([a-z])\1\1"), re.compile(rb"\b[A-Za-z][ .\-_][A-Za-z][ .\-_][A-Za-z]\b")
_MARKS, _SHOUTED = re.compile(rb"[!?]{2,}"), re.compile(rb"\b[A-Z]{3,}\b")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def features_of(text: bytes | None, weights: Weights, fixed: frozenset[bytes], second: frozenset[bytes]) -> list[float]:
    text = text or b""
    words = alnum_words(text)
    n = max(1, len(words))
    weight = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    plain = [i for i, w in enumerate(words) if w in fixed]
    hits = np.nonzero(weight)[0].tolist()
    near = sum(any(w in second for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in {*plain, *hits})
    rate = lambda pattern: len(pattern.findall(text)) / n
    capitals = len(text) - len(text.translate(None, _UPPER))
    return [
        float(np.log1p(len(words))), len(plain) / n, min(len(plain), 10), len(hits) / n, min(len(hits), 10), float(weight.sum()) / n, float(weight.max(initial=0)),
        len({words[i] for i in hits}), sum(w in second for w in words) / n, near / n, capitals / max(1, len(text)), rate(_SHOUTED), text.count(b"!") / n, text.count(b"?") / n,
        rate(_MARKS), rate(_INSIDE_DIGITS), rate(_INSIDE_SIGNS), rate(_STRETCHED), rate(_SPELLED),
    ]


def _matrix(texts: pa.Array, weights: Weights) -> np.ndarray:
    fixed, second = (frozenset(w.encode() for w in words) for words in (INSULTS, SECOND_PERSON))
    rows = [features_of(x, weights, fixed, second) for x in texts.cast(pa.binary()).to_pylist()]
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


def _featured(lexicon: dict[bytes, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in batches:
            rows = _matrix(batch.column(0), weights)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["toxic", "part", "features"])

    return run


class Classifier:
    """Lexicon, trees and calibration: a few hundred KB, whatever the corpus."""

    def __init__(self, lexicon: dict[bytes, float], trees: Trees, calibrated: Isotonic):
        self.lexicon, self.trees, self.calibrated = lexicon, trees, calibrated

    def score(self, texts: pa.Array, weights: Weights) -> np.ndarray:
        return np.clip(self.calibrated(self.trees.margin(_matrix(texts, weights))), 0.0, 1.0)


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out_fold: int, max_rows: int) -> Classifier:
    """Learns from at most ``max_rows`` labelled rows outside the held-out fold."""
    known = need(labels, id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic")).where(F.pmod(id_crc(F.col("id")), F.lit(folds)) != held_out_fold)
    order = F.xxhash64(F.lit("toxicity"), "id")
    chosen = materialized(known.orderBy(order, "id").limit(max_rows).select("id", "toxic", F.pmod(order, F.lit(10)).cast("int").alias("part")), "labelled")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # max_rows rows at most
    texts = materialized(texts.select("text", "toxic", "part"), "labelled-texts")
    lexicon = learned_lexicon(texts.where("part < 5").select("text", "toxic"))
    rows = texts.where("part >= 5").mapInArrow(_featured(lexicon), "toxic int, part int, features array<double>").toArrow()  # max_rows rows at most
    toxic, part = rows["toxic"].to_numpy(), rows["part"].to_numpy()
    x = np.array(rows["features"].to_pylist(), np.float64).reshape(len(toxic), len(FEATURES))
    order = np.lexsort((*x.T, toxic))  # the same trees, in whatever order rows arrive
    x, toxic, part = x[order], toxic[order], part[order]
    trees = fitted(x[part < 8], toxic[part < 8])
    return Classifier(lexicon, trees, Isotonic(trees.margin(x[part >= 8]), toxic[part >= 8]))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, folds: int = 5, held_out_fold: int = 0, max_rows: int = 20_000) -> DataFrame:
    """id, held_out, score and predicted of every row.

    Rows whose crc32(id as text) mod ``folds`` is ``held_out_fold`` are never learned from. Null texts are empty
    ones. Null ids are scored, not learned from, and count as the text '' for the fold. An id labelled both ways
    counts as toxic; null labels count as none. Without labels every score is near 0. Repeated rows score alike. Other
    columns, language and source among them, are not read.
    """
    tuned(docs.sparkSession)
    docs = need(docs, id_col, text_col)
    model = trained(docs, labels, id_col, text_col, label_col, folds, held_out_fold, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.trees, model.calibrated))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*shared.value)
        weights = Weights(own.lexicon)
        for batch in batches:
            score = own.score(batch.column(2), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col), (F.pmod(id_crc(F.col(id_col)), F.lit(folds)) == held_out_fold).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")
