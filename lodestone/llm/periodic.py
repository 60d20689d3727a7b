"""Periodic run detection: stretches of words that repeat with a period, found by divide and conquer (Main and Lorentz).

A text is halved again and again. Runs that cross a midpoint are read off two Z-functions: of the words after it, and
of the words before it, backwards. A run of four periods or more has two of them on one side of any word inside it, so on that side its
period is a place where the Z-function reaches as far as the place itself; on the other side the words are compared directly. A run that
reaches beyond its half crosses the midpoint of a larger one and is found there whole, so it is looked at one word beyond only.
Intervals that several periods give are kept with the smallest.

Words are interned, a batch of texts at a time. A run has successive trigrams that stood at most a period earlier, so halves
without such trigrams hold no run and are left out. Texts are independent rows: no shuffle, and a lost task costs its own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import need, tuned

#: Words of the texts that are interned together; a longer text is taken by itself.
WORDS_AT_ONCE = 1_000_000


def z_function(s: list[int]) -> list[int]:
    """Of each place, how many words from there on are those at the beginning."""
    n = len(s)
    z = [n] * min(n, 1) + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right or i >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _one_side(z: list[int], least: int) -> list[int]:
    """Periods whose run has two periods or more, and half of the least length, on the side that z is of."""
    return [q for q in range(1, len(z) // 2 + 1) if z[q] >= q and 2 * (z[q] + q) >= least]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words are the same."""
    n = min(len(a), len(b))
    step, at = 64, 0
    while at < n:
        end = min(n, at + step)
        differs = np.flatnonzero(a[at:end] != b[at:end])
        if len(differs):
            return at + int(differs[0])
        at, step = end, 4 * step
    return n


def _hot(ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks the places of trigrams that stood near enough before, within their text, to be inside a run."""
    n = len(ids)
    hot = np.zeros(n, bool)
    if n < 4:
        return hot
    many = np.int64(ids.max()) + 1
    pair = ids[:-1] * many + ids[1:]
    if many >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    code = pair[:-1] * many + ids[2:]
    whole = owner[:-2] == owner[2:]
    order = np.argsort(code, kind="stable")
    same = (code[order][1:] == code[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & whole[order][1:] & whole[order][:-1]
    back = np.zeros(n - 2, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    there = back > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], there, [False]]).astype(np.int8)) | np.concatenate([[False], owner[1 : n - 2] != owner[: n - 3], [False]]))
    begins = edge[:-1]
    length = np.diff(edge)
    stretch = np.repeat(length, length)
    first = begins[0] if len(begins) else 0
    hot[first : first + len(stretch)] = there[first : first + len(stretch)] & (back[first : first + len(stretch)] * 3 <= stretch + 2)
    return hot


def runs(ids: np.ndarray, hot: np.ndarray | None = None, min_words: int = 6, min_periods: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. hot: see ``_hot``; without it every half is gone through.

    ``min_periods`` is 4 at least: two periods on one side of every word are what the search goes by.
    """
    if min_periods < 4:
        raise ValueError("runs of fewer than four periods are not found by one side alone")
    n = len(ids)
    before = np.arange(n + 1) if hot is None else np.concatenate([[0], np.cumsum(hot)])
    found: dict[tuple[int, int], int] = {}

    def keep(begin: int, end: int, q: int) -> None:
        if end - begin >= max(min_words, min_periods * q):
            found[begin, end] = min(q, found.get((begin, end), q))

    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if high - low < min_words or before[high] == before[low]:
            continue
        mid = (low + high) // 2
        stack += [(low, mid), (mid, high)]
        for side in (1, -1):
            # The words on this side of the midpoint, going away from it, and those on the other side, likewise.
            near = ids[mid:high] if side == 1 else ids[low:mid][::-1]
            z = z_function(near.tolist())
            seen: list[tuple[int, int]] = []  # (period, reach on this side) of the runs at this midpoint
            for q in _one_side(z, min_words):
                reach = q + z[q]
                if any(q % p == 0 and reach == r for p, r in seen):
                    continue  # the same stretch with a multiple of its period
                if side == 1:
                    other = _common(ids[low:mid][::-1], ids[low : mid + q][::-1])
                    begin, end = mid - other, mid + reach
                else:
                    other = _common(ids[mid:high], ids[mid - q : high])
                    begin, end = mid - reach, mid + other
                seen.append((q, reach))
                beyond = (begin == low and low > 0 and ids[low - 1] == ids[low - 1 + q]) or (end == high and high < n and ids[high] == ids[high - q])
                if not beyond:
                    keep(begin, end, q)
    return sorted((begin, end - begin, q) for (begin, end), q in found.items())


def _batches(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, so many texts at a time as have ``WORDS_AT_ONCE`` words together."""
    group: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = text.split() if text else []
        if group and size + len(words) > WORDS_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _found(min_words: int, min_periods: int, digest: bool):
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def described(words: list[bytes], got: list[tuple[int, int, int]]) -> tuple:
        kept = words
        if got:
            drop = np.zeros(len(words) + 1, np.int64)
            for start, length, period in got:
                drop[start + period] += 1
                drop[start + length] -= 1
            kept = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        collapsed = b" ".join(kept)
        if digest:
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in got).encode()
            longest = max(got, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
            return len(got), *longest, hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapsed).hexdigest()
        return [{"start": s, "length": n, "period": p} for s, n, p in got], collapsed.decode(errors="replace")

    names, types = (["n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256"], [*[pa.int64()] * 4, pa.string(), pa.string()]) if digest else (["runs", "collapsed"], [pa.list_(run_type), pa.string()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group in _batches(batch.column(1).cast(pa.binary()).to_pylist()):
                number: dict[bytes, int] = {}
                lengths = np.array([len(w) for w in group], np.int64)
                ids = np.fromiter((number.setdefault(w, len(number)) for words in group for w in words), np.int64, int(lengths.sum()))
                hot = _hot(ids, np.repeat(np.arange(len(group)), lengths))
                ends = np.cumsum(lengths).tolist()
                for words, end in zip(group, ends, strict=True):
                    begin = end - len(words)
                    there = hot[begin:end]
                    out.append(described(words, runs(ids[begin:end], there, min_words, min_periods) if there.any() else []))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", *names])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 6, min_periods: int = 4, digest: bool = False) -> DataFrame:
    """(id, runs, collapsed) of each row. runs: (start, length, period) of every stretch of words, of ``min_words`` and ``min_periods`` periods
    or more, whose words a period apart are the same and that no neighbour extends; the smallest period of each. collapsed: the words that
    no run contains after its first period, joined by one space.

    With ``digest``, in place of these: n_runs, the longest run (ties: smallest start, then period; nulls without one), and digests of
    the runs' ``start,length,period`` lines and of the collapsed text. Null and empty texts have no words, no runs and an empty collapsed
    text. Ids pass as they are, nulls and repeats included. Other columns are not read. An empty table gives an empty one.
    """
    tuned(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    what = "n_runs bigint, start bigint, length bigint, period bigint, runs_sha256 string, collapsed_sha256 string" if digest else "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    found = need(docs, id_col, text_col).mapInArrow(_found(min_words, min_periods, digest), f"id {kind}, {what}")
    return found.withColumnRenamed("id", id_col)


def with_planted(text: Column, h: Column) -> Column:
    """``text`` with a periodic tail where ``h`` is divisible by 10; only the words count, so spaces become single ones there.

    With g = h div 10 and n words, each word from a = g % n on is the word of (a + its distance from a modulo p),
    p = 1 + (n - a) div (3 + g % 8).
    """
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    g = F.floor(h / 10)

    def planted(parts: Column) -> Column:
        w, a = parts["w"], parts["a"]
        p = 1 + F.floor((F.size(w) - a) / (3 + parts["g"] % 8))
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))

    parts = F.struct(words.alias("w"), (g % F.greatest(F.size(words), F.lit(1))).alias("a"), g.alias("g"))
    changed = F.array_join(F.element_at(F.transform(F.array(parts), planted), 1), " ")
    return F.when((h % 10 == 0) & (F.size(words) > 0), changed).otherwise(text)
