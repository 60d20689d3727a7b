"""Substring dedup: near-duplicate passages by compact windows.

A document is the sequence of its five-word shingles. Under one hash function every run of at least ``least`` shingles has
a minimum; a compact window (l, c, r) is all runs from l..c to c..r, which share the minimum at c. The windows of a
document are the nodes of its Cartesian tree that are wide enough, about 2 n / least of them. Runs that are alike have the same
minimum with the probability of their Jaccard similarity, so ``functions`` hash functions find nearly all of them.

Windows whose minimum no other window has are dropped. A run of ``least`` shingles has ``least`` / 2 - 1 shingles beside its
minimum, on one side at least, so windows are grouped by their minimum and the second minimum there on either side; without
that, a phrase that is common but shorter than a passage would bring unlike documents together. A second minimum, unlike
the shingle at a fixed place, stays the same where words are inserted or deleted. Each window is tied to
the earliest of its groups: as many ties as windows, however many documents share a passage. The ties of two
documents are joined as intervals across the hash functions, per diagonal; both stretches are compared, and a run of
``least`` shingles counts as repeated where the other stretch has it, near the same place, in a Jaccard similarity of
``similarity`` or more.

That is not all of a group: what a window shares with another member, beyond what it shares with the earliest, comes in the next round.
A window that a confirmed stretch covers whole has nothing left to find. Any other goes on in finer groups, one a side, named by the
first shingle there at which it parts from the earliest (beside the confirmed stretch, or the first that differs where none is
confirmed). Two members with a run in common that the earliest lacks part from it at the same shingle on one side at least, so
they meet again; members that only share a common phrase part at shingles of their own and are left alone. The earliest of
each group leaves it, so the rounds end, when no group has two; no pairs of a group are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import drop_table, materialized, need, tuned
from lodestone.llm.components import connected_components
from lodestone.llm.wordhash import mixed, run_hashes, space_words, word_codes

SHINGLE, LEAST_WORDS, SIMILARITY, FUNCTIONS = 5, 50, 0.8, 4
#: How many words a near copy may have more or less before a place than its original.
SLACK = 16
#: A window's place and how far it goes to the left and to the right of it, in one number.
REACH_BITS = 12
FAR = (1 << REACH_BITS) - 1


def shingles_of(text: bytes | None) -> np.ndarray:
    """Hashes of a text's five-word shingles, in order."""
    return run_hashes(word_codes(space_words(text)), SHINGLE)


def function(shingles: np.ndarray, which: int) -> np.ndarray:
    return mixed(shingles ^ np.uint64(0x5851F42D4C957F2D * (which + 1) & 0xFFFFFFFFFFFFFFFF))


def untied(values: np.ndarray) -> np.ndarray:
    """Ranks of ``values``; equal ones in an order without a pattern, so that a tree over repeated words stays shallow."""
    ranks = np.empty(len(values), np.int64)
    ranks[np.lexsort((mixed(np.arange(len(values), dtype=np.uint64)), values))] = np.arange(len(values))
    return ranks


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r), r included, for the Cartesian tree's nodes of ``least`` values or more; of equal minima the first is the root."""
    out, stack = [], [(0, len(values))]
    while stack:
        low, high = stack.pop()
        if high - low < least:
            continue
        c = low + int(values[low:high].argmin())
        out.append((low, c, high - 1))
        stack += [(low, c), (c + 1, high)]
    return out


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """``least`` (a minimum or a maximum) over each run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        values, done = least(values[:-done], values[done:]), 2 * done
    return least(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def wide_nodes(order: np.ndarray, least: int) -> np.ndarray:
    """Places of the nodes of ``least`` values or more in the Cartesian trees of stretches that zeros part from each other.

    A node is that wide where its value is the minimum of a run of ``least`` values, without a zero.
    """
    if len(order) < least:
        return np.empty(0, np.int64)
    minima = _sliding(order, least, np.minimum)
    edge = np.zeros(least - 1, order.dtype)
    return np.nonzero((_sliding(np.concatenate([edge, minima, edge]), least, np.maximum) == order) & (order > 0))[0]


def _beside(hashed: np.ndarray, order: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of each node in ``at``: how far it goes to the left and to the right, at most ``least`` - 1; the least hash among the ``least`` / 2 - 1 places
    before it and among those after it. A stretch has ``least`` places without values on both sides, 0 in ``order`` and the largest number in ``hashed``."""
    width, steps = least // 2 - 1, np.arange(1, least)
    out = []
    for side in (-1, 1):
        places = at[:, None] + side * steps
        smaller = order[places] < order[at][:, None]
        reach = np.where(smaller.any(1), smaller.argmax(1), least - 1) if least > 1 else np.zeros(len(at), np.int64)
        out += [reach, hashed[places[:, :width]].min(1) if width > 0 else np.zeros(len(at), np.uint64)]
    return out[0], out[2], out[1], out[3]


#: Nodes whose surroundings are looked at together, and words whose shingles are: what a task holds beside its longest text.
NODES, TOGETHER = 1 << 15, 1 << 19


def _nodes(texts: list[np.ndarray], least: int, functions: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, value, context, place with its reaches) of the windows of some texts under each function."""
    edge = np.zeros(least, np.uint64)
    begun = np.cumsum([least] + [len(t) + least for t in texts])[:-1]
    inside = np.concatenate([edge.astype(bool), *[x for t in texts for x in (np.ones(len(t), bool), edge.astype(bool))]])
    shingles = np.concatenate([edge, *[x for t in texts for x in (t, edge)]])
    ordered = [np.sort(t) for t in texts]
    plain = np.array([not (t[1:] == t[:-1]).any() for t in ordered])
    half = max(least // 2, 1)
    for f in range(functions):
        hashed = function(shingles, f)
        hashed[~inside] = np.iinfo(np.uint64).max
        order = np.where(inside, hashed, 0)
        for i in np.nonzero(~plain)[0]:
            order[begun[i] : begun[i] + len(texts[i])] = untied(hashed[begun[i] : begun[i] + len(texts[i])]) + 1
        nodes = wide_nodes(order, least)
        parts = []
        for some in np.split(nodes, range(NODES, len(nodes), NODES)):
            left, right, before, after = _beside(hashed, order, some, least)
            text = np.searchsorted(begun, some, side="right") - 1
            # The low 32 bits of each: the high ones of a minimum are mostly zeros.
            context = (before & np.uint64(0xFFFFFFFF) | (after & np.uint64(0xFFFFFFFF)) << np.uint64(32)).view(np.int64)
            parts.append(np.stack([text, hashed[some].view(np.int64), context, (some - begun[text]) << 2 * REACH_BITS | left << REACH_BITS | right]))
        text, value, context, at = np.concatenate(parts, axis=1)
        if not plain.all():  # of equal windows within half a run one is enough, the stretches around it are compared
            twice = np.nonzero(~plain[text])[0]
            part = np.stack([text[twice], value[twice], context[twice], (at[twice] >> 2 * REACH_BITS) // half])
            kept = np.sort(np.concatenate([np.nonzero(plain[text])[0], twice[np.unique(part, axis=1, return_index=True)[1]]]))
            text, value, context, at = text[kept], value[kept], context[kept], at[kept]
        yield text, value, context, at


def _windows(least: int, functions: int):
    def found(docs: list[int], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = np.array(docs, np.int64)
        for text, value, context, at in _nodes(texts, least, functions):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (value, context, ids[text], at)], names=["v", "x", "doc", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, total = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                shingles = shingles_of(text)
                if len(shingles) >= least:
                    docs.append(doc)
                    texts.append(shingles)
                    total += len(shingles)
                if total >= TOGETHER:
                    yield from found(docs, texts)
                    docs, texts, total = [], [], 0
            if docs:
                yield from found(docs, texts)

    return run


def _first_ties(windows: DataFrame) -> DataFrame:
    """(key, doc, at, to): each window with the earliest one of either of its groups, where that is another one.

    One shuffle by the minimum serves the count and both groups, which are parts of the minimum's.
    """
    shared = windows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("v"))).where("n > 1")
    sides = [shared["x"].bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftrightunsigned(shared["x"], 32)]
    both = shared.select("v", "doc", "at", *[side.alias(f"x{i}") for i, side in enumerate(sides)])
    for i in range(2):
        both = both.withColumn(f"to{i}", F.min(F.struct("doc", "at")).over(Window.partitionBy("v", f"x{i}")))
    groups = F.array(*[F.struct(F.xxhash64("v", F.lit(i), f"x{i}").alias("key"), F.col(f"to{i}").alias("to")) for i in range(2)])
    return both.select("doc", "at", F.inline(groups)).where("to.doc <> doc or to.at <> at")


def _further_ties(rows: DataFrame) -> DataFrame:
    """The same of rows (key, doc, at)."""
    return rows.withColumn("to", F.min(F.struct("doc", "at")).over(Window.partitionBy("key"))).where("to.doc <> doc or to.at <> at")


def _pairs(ties: DataFrame, least: int) -> DataFrame:
    """(doc, to_doc, diagonal, lo, hi, to_lo, to_hi, windows): a row for each two documents and diagonal, the stretches that may be alike and the windows tied there."""
    place = F.shiftright("at", 2 * REACH_BITS).cast("int")
    ties = ties.withColumn("c", place).withColumn("diagonal", F.col("c") - F.shiftright("to.at", 2 * REACH_BITS).cast("int"))
    merged = ties.groupBy("doc", F.col("to.doc").alias("to_doc"), "diagonal").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.collect_list(F.struct("key", "at")).alias("windows"))
    # A run that has a tied window's minimum reaches less than a run's length beyond it.
    lo, hi = F.greatest(F.col("least") - least - SLACK, F.lit(0)), F.col("most") + least + SLACK
    return merged.select("doc", "to_doc", "diagonal", lo.alias("lo"), hi.alias("hi"), F.greatest(lo - F.col("diagonal") - SLACK, F.lit(0)).alias("to_lo"), (hi - F.col("diagonal") + SLACK).alias("to_hi"), "windows")


def _shingles(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of a text, 32 bits of each: enough to compare two documents."""
        for batch in batches:
            whole = [(shingles_of(text) >> np.uint64(32)).astype(np.uint32) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            long = [i for i, s in enumerate(whole) if len(s) >= least]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(long, pa.int32())), pa.array([whole[i].tobytes() for i in long], pa.binary())], names=["doc", "shingles"])

    return run


def near_places(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Whether ``b`` has each value of ``a`` within SLACK places of its own place there plus ``shift``."""
    there = np.sort(b.astype(np.uint64) << np.uint64(32) | np.arange(len(b), dtype=np.uint64))
    at = np.arange(len(a), dtype=np.int64) + shift
    asked = a.astype(np.uint64) << np.uint64(32)
    first, last = (np.searchsorted(there, asked | np.clip(at + d, 0, 0xFFFFFFFF).astype(np.uint64)) for d in (-SLACK, SLACK + 1))
    return last > first


def alike(a: np.ndarray, b: np.ndarray, least: int, similarity: float, shift: int | None = None) -> list[tuple[int, int]]:
    """(begin, end), end included, of the stretches of ``a`` covered by runs of ``least`` shingles that ``b`` has in that similarity.

    Two runs of n shingles of which m are shared have a Jaccard similarity of m / (2 n - m). Ends that aren't shared are cut. With
    ``shift`` a shingle is shared only near its place plus that shift.
    """
    shared = np.isin(a, b) if shift is None else near_places(a, b, shift)
    enough = int(np.ceil(2 * least * similarity / (1 + similarity) - 1e-9))
    if len(a) < least or shared.sum() < enough:
        return []
    sums = np.concatenate([[0], np.cumsum(shared)])
    good = np.nonzero(sums[least:] - sums[:-least] >= enough)[0]
    out: list[list[int]] = []
    for begin in good.tolist():
        if out and begin <= out[-1][1] + 1:
            out[-1][1] = begin + least - 1
        else:
            out.append([begin, begin + least - 1])
    places = np.nonzero(shared)[0]
    return [(int(places[np.searchsorted(places, x)]), int(places[np.searchsorted(places, y, side="right") - 1])) for x, y in out]


def parted(a: np.ndarray, b: np.ndarray, shift: int, spans: list[tuple[int, int]], key: np.ndarray, at: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, at) of the finer groups of windows that no span covers: a key for each side, by the shingle where ``a`` parts from ``b``."""
    c, left, right = (at >> 2 * REACH_BITS) - base, at >> REACH_BITS & FAR, at & FAR
    place = np.arange(len(a)) + shift
    inside = (place >= 0) & (place < len(b))
    same = np.zeros(len(a), bool)
    same[inside] = a[inside] == b[place[inside]]
    differ = np.concatenate([[-1], np.nonzero(~same)[0], [len(a)]])
    known = (c >= 0) & (c < len(a))
    after = np.searchsorted(differ, c, side="right")
    ends = differ[np.minimum(after, len(differ) - 1)]
    begins = differ[np.maximum(np.searchsorted(differ, c) - 1, 0)]
    for s, e in spans:
        within = (c >= s) & (c <= e)
        begins, ends = np.where(within, s - 1, begins), np.where(within, e + 1, ends)
    keys, places = [], []
    for side, edge, open_ in ((1, begins, known & (begins >= np.maximum(c - left, 0))), (2, ends, known & (ends <= np.minimum(c + right, len(a) - 1)))):
        keys.append(mixed(key[open_].view(np.uint64) ^ mixed(a[edge[open_]].astype(np.uint64) << np.uint64(2) | np.uint64(side))).view(np.int64))
        places.append(at[open_])
    return np.concatenate(keys), np.concatenate(places)


class Stretches:
    """Shingles of many stretches one after the other, each between two places without one."""

    def __init__(self, parts: list[bytes]):
        self.sizes = np.array([len(p) // 4 for p in parts], np.int64)
        self.starts = 1 + np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        self.inside = np.ones(int(self.sizes.sum()) + len(parts) + 1, bool)
        self.inside[0] = False
        self.inside[self.starts + self.sizes] = False
        self.values = np.full(len(self.inside), -1, np.int64)
        self.values[self.inside] = np.frombuffer(b"".join(parts), np.uint32)
        self.of = np.repeat(np.arange(len(parts)), self.sizes)  # of the places inside
        self.places = np.nonzero(self.inside)[0]

    def at(self, which: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Values by stretch and place in it; -2 beyond its ends, so that nothing is equal to it."""
        known = (local >= 0) & (local < self.sizes[which])
        return np.where(known, self.values[np.where(known, self.starts[which] + local, 0)], -2)


def same_and_shared(a: Stretches, b: Stretches, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all places of ``a``: whether ``b`` has the same value at that place plus ``shift``, and whether it has it within SLACK places of that."""
    there = a.places - a.starts[a.of] + shift[a.of]
    same, shared = np.zeros(len(a.values), bool), np.zeros(len(a.values), bool)
    same[a.places] = a.values[a.places] == b.at(a.of, there)
    shared |= same
    rest = np.nonzero(~same[a.places])[0]
    which, place, there = a.of[rest], a.places[rest], there[rest]
    for d in range(-SLACK, SLACK + 1):
        shared[place] |= a.values[place] == b.at(which, there + d)
    return same, shared


def covered(a: Stretches, shared: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, begin, end) of the spans that ``alike`` names, of all stretches in order; places in the whole, end included."""
    enough = int(np.ceil(2 * least * similarity / (1 + similarity) - 1e-9))
    sums = np.concatenate([[0], np.cumsum(shared)])
    room = a.starts[a.of] + a.sizes[a.of] - a.places >= least
    begun = a.places[room]
    enough_there = sums[begun + least] - sums[begun] >= enough
    good, which = begun[enough_there], a.of[room][enough_there]
    fresh = np.ones(len(good), bool)
    fresh[1:] = (np.diff(good) > least) | (np.diff(which) > 0)
    first = np.nonzero(fresh)[0]
    last = np.append(first[1:], len(good)) - 1 if len(first) else first
    places = np.nonzero(shared)[0]
    return which[first], places[np.searchsorted(places, good[first])], places[np.searchsorted(places, good[last] + least - 1, side="right") - 1]


def parted_all(a: Stretches, same: np.ndarray, spans: tuple[np.ndarray, np.ndarray], which: np.ndarray, key: np.ndarray, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
    """(stretch, key, at): what ``parted`` gives for windows of many stretches, in the order of the stretches."""
    c, left, right = (at >> 2 * REACH_BITS) - base[which], at >> REACH_BITS & FAR, at & FAR
    known = (c >= 0) & (c < a.sizes[which])
    which, key, at, c, left, right = (x[known] for x in (which, key, at, c, left, right))
    place, low = a.starts[which] + c, a.starts[which]
    high = low + a.sizes[which] - 1
    differ = np.nonzero(~same)[0]
    ends = differ[np.searchsorted(differ, place, side="right")]
    begins = differ[np.searchsorted(differ, place) - 1]
    if len(spans[0]):
        near = np.searchsorted(spans[0], place, side="right") - 1
        within = (near >= 0) & (place <= spans[1][near])
        begins, ends = np.where(within, spans[0][near] - 1, begins), np.where(within, spans[1][near] + 1, ends)
    out = []
    for side, edge, open_ in ((1, begins, begins >= np.maximum(place - left, low)), (2, ends, ends <= np.minimum(place + right, high))):
        keys = mixed(key[open_].view(np.uint64) ^ mixed(a.values[edge[open_]].astype(np.uint64) << np.uint64(2) | np.uint64(side)))
        out.append((which[open_], keys.view(np.int64), at[open_]))
    which, keys, at = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(which, kind="stable")
    return which[order], keys[order], at[order]


def _lists(which: np.ndarray, n: int, **columns: np.ndarray) -> pa.ListArray:
    """A list of structs for each of ``n`` rows, from rows in order."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns)))


def _verified(least: int, similarity: float):
    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        diagonal, lo, to_lo = (batch.column(i).to_numpy().astype(np.int64) for i in range(2, 5))
        a, b = (Stretches(batch.column(i).to_pylist()) for i in (5, 6))
        shift = lo - diagonal - to_lo  # a place of a, less lo, is that much more in b
        sides, same = [], None
        for one, two, by in ((a, b, shift), (b, a, -shift)):
            same_here, shared = same_and_shared(one, two, by)
            same = same_here if same is None else same
            sides.append(covered(one, shared, least, similarity))
        both = np.isin(np.arange(n), sides[0][0]) & np.isin(np.arange(n), sides[1][0])
        sides = [tuple(x[both[side[0]]] for x in side) for side in sides]
        spans = []
        for of, base, (which, begin, end) in ((a, lo, sides[0]), (b, to_lo, sides[1])):
            move = base[which] - of.starts[which]
            spans.append(_lists(which, n, begin=(begin + move).astype(np.int32), end=(end + move + SHINGLE).astype(np.int32)))
        windows = batch.column(7)
        key, at = (windows.flatten().field(i).to_numpy() for i in range(2))
        which, key, at = parted_all(a, same, sides[0][1:], np.repeat(np.arange(n), pc.list_value_length(windows).to_numpy()), key, at, lo)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *spans, _lists(which, n, key=key, at=at)], names=["doc", "to_doc", "spans", "to_spans", "finer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.binary_length(batch.column(i)).to_numpy().astype(np.int64) // 4 for i in (5, 6))
            group = np.cumsum(sizes) // TOGETHER
            for part in np.split(np.arange(batch.num_rows), np.nonzero(np.diff(group))[0] + 1):
                if len(part):
                    yield judged(batch.take(pa.array(part)))

    return run


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """(doc, to_doc, spans, to_spans): passages of ``doc`` that ``to_doc`` has too, in words, end excluded.

    Each passage is tied to the earliest place with it, not to all of them unless the earliest differs; that may be in the same document. Rows with a null id are left
    out here; rows that repeat an id are taken for one document, whose stretches are compared in one of its texts.
    """
    tuned(docs.sparkSession)
    least = least_words - SHINGLE + 1
    if not 1 <= least <= FAR - SLACK:
        raise ValueError(f"least_words must be from {SHINGLE} to {FAR - SLACK + SHINGLE - 1}")
    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    ties = _first_ties(rows.mapInArrow(_windows(least, functions), "v bigint, x bigint, doc bigint, at bigint"))
    found, shingles, judged = docs.sparkSession.createDataFrame([], FOUND), None, None
    while True:
        pairs = materialized(_pairs(ties, least), "pairs")
        if judged is not None:
            drop_table(judged)
        if pairs.isEmpty():
            break
        if shingles is None:  # later rounds ask for no other documents
            shingles = materialized(_stored(rows, pairs, least), "shingles")
        judged = _judged(shingles, pairs, least, similarity)
        drop_table(pairs)
        found = found.union(materialized(judged.where(F.size("spans") > 0).select(*found.columns), "spans"))
        ties = _further_ties(judged.select("doc", F.inline("finer")).distinct())
    for table in (pairs, shingles):
        if table is not None:
            drop_table(table)
    return found


def _stored(rows: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(doc, shingles) of the documents of the pairs: texts are neither shuffled nor read again after this."""
    asked = pairs.select("doc").union(pairs.select("to_doc")).distinct()
    return rows.mapInArrow(_shingles(least), "doc bigint, shingles binary").join(asked, "doc", "left_semi").groupBy("doc").agg(F.max("shingles").alias("shingles"))


def _judged(shingles: DataFrame, pairs: DataFrame, least: int, similarity: float) -> DataFrame:
    """(doc, to_doc, spans, to_spans, finer) of the pairs."""
    # Each stretch is cut out of its document's before it goes on.
    one = pairs.join(shingles, "doc").withColumn("one", F.expr("substring(shingles, lo * 4 + 1, (hi - lo + 1) * 4)")).drop("shingles")
    both = one.join(shingles.withColumnRenamed("doc", "to_doc"), "to_doc").withColumn("two", F.expr("substring(shingles, to_lo * 4 + 1, (to_hi - to_lo + 1) * 4)"))
    span = "array<struct<begin:int,end:int>>"
    judge = both.select("doc", "to_doc", "diagonal", "lo", "to_lo", "one", "two", "windows")
    judge = judge.mapInArrow(_verified(least, similarity), f"doc bigint, to_doc bigint, spans {span}, to_spans {span}, finer array<struct<key:bigint,at:bigint>>")
    return materialized(judge, "judged")


FOUND = "doc bigint, to_doc bigint, spans array<struct<begin:int,end:int>>, to_spans array<struct<begin:int,end:int>>"


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per id: n_words, n_repeated (words in passages that stand elsewhere too), spans (those passages, in words, end
    excluded, merged), n_links, linked_to (the earliest other documents with them) and class_id (the smallest id
    reachable over shared passages, its own without one).

    Null and short texts have no passages. Rows that repeat an id count as one document, with the most words of any;
    rows with a null id have a row with a null class. Other columns are not read. An empty table gives an empty one.
    """
    found = materialized(passages(docs, id_col, text_col, **how), "passages")
    classes = connected_components(found.select(F.col("doc").alias("src"), F.col("to_doc").alias("dst")))
    spans = found.select("doc", F.inline("spans")).union(found.select(F.col("to_doc"), F.inline("to_spans"))).distinct()
    before = F.max("end").over(Window.partitionBy("doc").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("fresh", F.col("begin") > F.coalesce(before, F.lit(-1)))
    grouped = begun.withColumn("part", F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("doc").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("doc", "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    of_doc = merged.groupBy("doc").agg(F.sum(F.col("end") - F.col("begin")).alias("n_repeated"), F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    links = found.where("doc <> to_doc").groupBy("doc").agg(F.array_sort(F.collect_set("to_doc")).alias("linked_to"))
    n_words = F.size(F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = need(docs, id_col, text_col).select(F.col(id_col).cast("bigint").alias("doc"), F.when(F.col(text_col).isNull(), 0).otherwise(n_words).cast("bigint").alias("n_words"))
    rows = rows.groupBy("doc").agg(F.max("n_words").alias("n_words"))
    out = rows.join(of_doc, "doc", "left").join(links, "doc", "left").join(classes.select(F.col("node").alias("doc"), "component"), "doc", "left")
    linked = F.coalesce("linked_to", F.array().cast("array<bigint>"))
    return out.select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_repeated", F.lit(0)).cast("bigint").alias("n_repeated"), F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"), F.size(linked).cast("bigint").alias("n_links"), linked.alias("linked_to"), F.coalesce("component", "doc").alias("class_id"))
