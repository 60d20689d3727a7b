"""Language-model scoring: a hidden Markov model over words, learned by Baum-Welch, beside an add-one unigram model.

Words are counted over all training documents. The ``SYMBOLS`` most frequent ones and the end of a text are symbols of
the model; every other word is emitted as one of ``CLASSES`` ending classes and then drawn within its class by the
add-one rule, so every text has a proper probability. Each Baum-Welch round reads all training texts whole: every
partition sums its expected counts, and only those sums (states x symbols, a fixed size) meet. Texts are learned from and
scored by the scaled forward recursion, many of like length at a time; of texts too long for that the states at the
borders of stretches are kept, and each stretch is gone through again on the way back, so counts are those of whole texts.

Word counts are a table, however many words there are. They are summed as packed arrays: each task sends its counts by
buckets of keys, a row for a bucket, and each bucket is added up by itself. Each task gets the counts of the ``HOT`` most frequent words (a
fixed size); what is left of a document, its rare words, meets the table of counts in a join on 64-bit word keys.
No key of that join is frequent, as the frequent ones never enter it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import id_crc, materialized, need, tuned
from lodestone.llm.wordhash import space_words

SYMBOLS, CLASSES, HOT = 2048, 256, 1 << 18
END = SYMBOLS
SIZE = SYMBOLS + 1 + CLASSES
#: Words that a task counts before it sends their counts; buckets of keys at least; cells (tokens of texts gone through together).
FLUSH, BUCKETS, CELLS = 1_000_000, 256, 1 << 19
#: Baum-Welch ends before its last round if the log likelihood grows by less than this share.
TOLERANCE = 1e-4


def word_keys(words: list[bytes]) -> np.ndarray:
    """A 64-bit key of each word (XXH3). Two of 10^9 different words share one with a probability of a few percent."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def word_class(word: bytes) -> int:
    """Class of a rare word: its last three bytes, hashed."""
    import zlib

    return zlib.crc32(word[-3:]) % CLASSES


def _counted(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (bucket, its keys, their counts and classes, packed)."""

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        keys, n, classes = word_keys(words), np.fromiter(counts.values(), np.int64, len(words)), np.fromiter(map(word_class, words), np.int16, len(words))
        bucket = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        there, first = np.unique(bucket[order], return_index=True)
        parts = [np.split(x[order], first[1:]) for x in (keys, n, classes)] if len(there) else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in parts)], names=["bucket", "keys", "n", "classes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(space_words(text))
            if len(counts) > FLUSH:
                yield from rows(counts)
                counts.clear()
        yield from rows(counts)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket's counts added up by key."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        for out, column, kind in zip(parts, (1, 2, 3), (np.int64, np.int64, np.int16), strict=True):
            out += [np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]
    keys, n, classes = map(np.concatenate, parts)
    order = np.argsort(keys, kind="stable")
    keys, n, classes = keys[order], n[order], classes[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    for at in range(0, len(first), 50_000):
        part, upto = first[at : at + 50_000], first[at + 50_000] if at + 50_000 < len(first) else len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(np.add.reduceat(n[:upto], part)), pa.array(classes[part])], names=["key", "n", "class"])


class Vocabulary:
    """Word counts of the training documents: a table of all, and what tasks need of them in bounded size."""

    def __init__(self, train: DataFrame, text_col: str):
        spark = train.sparkSession
        buckets = max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        packed = train.select(text_col).mapInArrow(_counted(buckets), "bucket int, keys binary, n binary, classes binary")
        self.table = materialized(packed.groupBy("bucket").applyInArrow(_added, "key bigint, n bigint, class smallint"), "vocabulary")
        self.texts = train.count()
        totals = self.table.agg(F.count(F.lit(1)), F.sum("n")).first()
        self.distinct, self.tokens = totals[0] + bool(self.texts), (totals[1] or 0) + self.texts
        hot = self.table.where(F.col("n") >= self._least_hot()).toArrow()  # HOT rows at most
        keys, n = hot["key"].to_numpy(), hot["n"].to_numpy()
        first = np.lexsort((keys, -n))
        symbol = np.full(len(keys), -1, np.int32)
        symbol[first[:SYMBOLS]] = np.arange(min(SYMBOLS, len(keys)))
        symbols = spark.createDataFrame([(int(k),) for k in keys[first[:SYMBOLS]]], "key bigint")
        rest = self.table.join(F.broadcast(symbols), "key", "left_anti").groupBy("class").agg(F.sum("n"), F.count(F.lit(1)))
        self.class_tokens, self.class_words = np.zeros(CLASSES), np.zeros(CLASSES)
        for which, tokens, words in rest.collect():  # CLASSES rows at most
            self.class_tokens[which], self.class_words[which] = tokens, words
        self.symbol_tokens = np.zeros(SYMBOLS)
        self.symbol_tokens[: min(SYMBOLS, len(keys))] = n[first[:SYMBOLS]]
        order = np.argsort(keys)
        self.shared = spark.sparkContext.broadcast((keys[order], n[order], symbol[order]))

    def _least_hot(self) -> int:
        """The least count at which at most ``HOT`` words have it or more, among powers of two and steps between them.

        An aggregation of a few hundred groups, where sorting for the first HOT words would end in one task.
        """
        step = F.when(F.col("n") < 32, F.col("n")).otherwise(F.floor(F.log2("n") * 32).cast("bigint"))
        rows = self.table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("least")).collect()
        total, least = 0, 1 << 62
        for row in rows:
            total += row.words
            if total > HOT:
                break
            least = row.least
        return least

    @property
    def base_total(self) -> int:
        """N + 1 * (V + 1)."""
        return self.tokens + self.distinct + 1


def _encoded(shared, base_total: int, end_count: int, class_totals: np.ndarray):
    """class_totals: of each class, its tokens, its distinct words and one for what was never seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_n, hot_symbol = shared.value
        log_total, log_class = math.log10(base_total), np.log10(class_totals)
        for batch in batches:
            texts = [space_words(x) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            lengths = np.array([len(words) for words in texts], np.int64)
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__  # words get numbers as they come up
            flat = np.fromiter((number[w] for words in texts for w in words), np.int64, lengths.sum())
            keys = word_keys(list(number))
            classes = np.fromiter(map(word_class, number), np.int64, len(number))
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                hot = hot_keys[at] == keys
                symbol, count = np.where(hot, hot_symbol[at], -1), np.where(hot, hot_n[at], 0)
            else:
                hot, symbol, count = np.zeros(len(keys), bool), np.full(len(keys), -1), np.zeros(len(keys), np.int64)
            base = np.log10(count + 1) - log_total
            # Within its class: a hot word that is no symbol of its own, and the open count's denominator of a rare one.
            within = np.where(symbol < 0, np.log10(count + 1) - log_class[classes], 0.0)
            coded = np.where(symbol >= 0, symbol, END + 1 + classes).astype(np.uint16)[flat]
            doc = np.repeat(np.arange(len(texts)), lengths)
            summed = lambda x: np.bincount(doc, weights=x[flat], minlength=len(texts))
            ends = np.cumsum(lengths)
            symbols = [coded[end - n : end].tobytes() + np.uint16(END).tobytes() for n, end in zip(lengths.tolist(), ends.tolist(), strict=True)]
            left = ~hot[flat]
            pairs, times = np.unique(doc[left] * max(1, len(number)) + flat[left], return_counts=True)
            owner, word = np.divmod(pairs, max(1, len(number)))
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(keys[word]), pa.array(times.astype(np.int32))], ["key", "n"]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(symbols, pa.binary()), pa.array(lengths + 1), pa.array(summed(hot).astype(np.int64) + (end_count > 0)),
                    pa.array(summed(base) + math.log10(end_count + 1) - log_total), pa.array(summed(within)), rare,
                ],
                names=["id", "held_out", "symbols", "n_tokens", "n_known", "base", "inside", "rare"],
            )

    return run


class Model:
    """Start, transition and emission probabilities; emission is symbols x states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, frequencies: np.ndarray, states: int, seed: int) -> Model:
        """Emissions near the overall frequencies, each state leaning another way; states that tend to stay."""
        lean = np.exp(np.random.default_rng(seed).normal(0, 0.5, (len(frequencies), states)))
        emit = (frequencies[:, None] + 1) * lean
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequencies: np.ndarray, prior: float = 1.0) -> Model:
        """Expected counts plus a little of the overall frequencies, so that no probability is 0."""
        start, move = start + prior, move + prior
        emit = emit + prior * (frequencies[:, None] + 1) / (frequencies.sum() + len(frequencies)) * len(frequencies)
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, longest first, as the columns of a table by time; how many are still going at each time; their order."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    table = np.zeros((lengths.max(), len(texts)), np.uint16)
    for column, i in enumerate(order):
        table[: lengths[i], column] = texts[i]
    return table, np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left"), order


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of each text's probability; whole texts of any length, by the scaled forward recursion."""
    out = np.zeros(len(texts))
    table, going, order = _padded(texts)
    total = np.zeros(len(texts))
    state = np.broadcast_to(model.start, (len(texts), len(model.start)))
    for t, n in enumerate(going):
        state = (state[:n] if t == 0 else state[:n] @ model.move) * model.emit[table[t, :n]]
        scale = state.sum(1)
        state = state / scale[:, None]
        total[:n] += np.log(scale)
    out[order] = total
    return out


def expected(model: Model, texts: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, cells: int = CELLS) -> float:
    """Adds the texts' expected counts to the three arrays (scaled forward and backward); gives their log likelihood.

    The states of ``cells`` tokens are kept at a time: of longer texts the ones at the borders of stretches, from which a
    stretch is gone through again when its turn comes on the way back.
    """
    table, going, _ = _padded(texts)
    steps, width, k = len(going), len(texts), len(model.start)
    stretch = max(1, cells // width)

    def step(t: int, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n = going[t]
        state = (model.start if t == 0 else state[:n] @ model.move) * model.emit[table[t, :n]]
        scale = state.sum(1)
        return state / scale[:, None], scale

    borders, state = [None], None
    for begin in range(0, steps - stretch, stretch):
        for t in range(begin, begin + stretch):
            state, _ = step(t, state)
        borders.append(state)
    total, back = 0.0, np.ones((width, k))
    for number in range(len(borders) - 1, -1, -1):
        begin, end = number * stretch, min((number + 1) * stretch, steps)
        ahead, scales = np.zeros((end - begin, going[begin], k)), np.ones((end - begin, going[begin]))
        state = borders[number]
        for t in range(begin, end):
            state, scales[t - begin, : going[t]] = step(t, state)
            ahead[t - begin, : going[t]] = state
        weights = np.zeros_like(ahead)
        for t in range(end - 1, begin - 1, -1):
            n = going[t]
            weights[t - begin, :n] = ahead[t - begin, :n] * back[:n]
            if t:
                arriving = model.emit[table[t, :n]] * back[:n] / scales[t - begin, :n, None]
                move += (ahead[t - begin - 1, :n] if t > begin else borders[number][:n]).T @ arriving * model.move
                back[:n] = arriving @ model.move.T
            else:
                start += weights[0].sum(0)
        there = np.arange(going[begin])[None, :] < going[begin:end, None]
        flat = table[begin:end, : going[begin]][there]
        for i in range(k):
            emit[:, i] += np.bincount(flat, weights=weights[:, :, i][there], minlength=len(emit))
        total += float(np.log(scales[there]).sum())
    return total


def _symbols(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16)


def _gathered(model: Model, tokens: int = 4_000_000):
    """One row for each partition: its expected counts and log likelihood, as one array. Texts are gathered up to so many
    tokens, so that those alike in length go together."""
    k, size = len(model.start), len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), 0.0
        texts: list[np.ndarray] = []
        gathered = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                texts += [_symbols(data) for data in batch.column(0).to_pylist()]
                gathered += sum(map(len, texts[len(texts) - batch.num_rows :]))
            if gathered >= tokens or batch is None:
                for group in groups(texts, CELLS):
                    total += expected(model, [texts[i] for i in group], start, move, emit)
                texts, gathered = [], 0
        everything = np.concatenate([start, move.ravel(), emit.ravel(), [total]])
        yield pa.RecordBatch.from_arrays([pa.array([everything.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def baum_welch(encoded: DataFrame, frequencies: np.ndarray, states: int = 6, rounds: int = 4, seed: int = 7) -> tuple[Model, list[float]]:
    """The model after ``rounds`` passes at most over all rows of ``encoded`` (symbols: binary), and the log likelihood before
    each; no more passes once a round has changed it by less than ``TOLERANCE`` of it."""
    model, likelihoods = Model.initial(frequencies, states, seed), []
    size = len(frequencies)
    for _ in range(rounds):
        sums = encoded.select("symbols").mapInArrow(_gathered(model), "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(states + states * states + size * states + 1)  # a fixed size, whatever the corpus
        flat[sums["at"].to_numpy()] = sums["x"].to_numpy()
        likelihoods.append(float(flat[-1]))
        if len(likelihoods) > 1 and abs(likelihoods[-1] - likelihoods[-2]) <= TOLERANCE * abs(likelihoods[-1]):
            break
        a, b = states, states + states * states
        model = Model.from_counts(flat[:a], flat[a:b].reshape(states, states), flat[b:-1].reshape(size, states), frequencies)
    return model, likelihoods


def groups(texts: list[np.ndarray], cells: int = 1 << 22) -> Iterator[list[int]]:
    """Positions of texts that are scored together, alike in length; a padded table has ``cells`` cells or one text."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        many = max(1, cells // max(1, len(texts[order[at]])))
        yield order[at : at + many]
        at += many


def _scored(model: Model, tokens: int = 4_000_000):
    """Texts are gathered up to so many tokens, so that those alike in length go together."""

    def scores(ids: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
        out = np.zeros(len(texts))
        for group in groups(texts):
            out[group] = forward(model, [texts[i] for i in group])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out)], names=["row", "ln"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[np.ndarray] = []
        gathered = 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += [_symbols(x) for x in batch.column(1).to_pylist()]
            gathered += sum(map(len, texts[-batch.num_rows :])) if batch.num_rows else 0
            if gathered >= tokens:
                yield scores(ids, texts)
                ids, texts, gathered = [], [], 0
        if ids:
            yield scores(ids, texts)

    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, held_out_fold: int = 2, states: int = 6, rounds: int = 4, seed: int = 7) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32(id as text) mod ``folds`` is ``held_out_fold`` are scored only, never learned from. Null texts are
    empty; every text has its end as its last token. Null ids count as the text '' for the fold. Repeated rows are
    learned from and scored each. Without training rows both models give every token the probability of an
    unseen one. Other columns are not read.
    """
    tuned(docs.sparkSession)
    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), (F.pmod(id_crc(F.col(id_col)), F.lit(folds)) == held_out_fold).alias("held_out"), F.col(text_col).alias("text"))
    words = Vocabulary(rows.where("not held_out"), "text")
    class_totals = words.class_tokens + words.class_words + 1
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, symbols binary, n_tokens bigint, n_known bigint, base double, inside double, rare array<struct<key:bigint,n:int>>"
    coded = rows.mapInArrow(_encoded(words.shared, words.base_total, words.texts, class_totals), schema)
    coded = materialized(coded.withColumn("row", F.monotonically_increasing_id()), "coded")  # written, so that row stays
    frequencies = np.concatenate([words.symbol_tokens, [words.texts], words.class_tokens])
    model, _ = baum_welch(coded.where("not held_out"), frequencies, states, rounds, seed)

    ln = coded.select("row", "symbols").mapInArrow(_scored(model), "row bigint, ln double")
    rare = coded.select("row", F.inline("rare")).select("row", "key", F.col("n").alias("times"))
    met = rare.join(words.table.select("key", F.col("n").alias("count")), "key").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("logs"))
    left = coded.select("row", "id", "held_out", "n_tokens", "n_known", "base", "inside")
    out = left.join(ln, "row").join(met, "row", "left")
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    score = F.col("ln") / math.log(10) + F.col("inside") + logs
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(words.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), score.alias("score"))
