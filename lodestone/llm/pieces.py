"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

A text's lattice has a node at each character and an edge for each vocabulary piece; a path is a segmentation, with a
probability in proportion to the product of its pieces' weights. ``k`` distinct paths are drawn without replacement: each
path has its log-probability perturbed by a Gumbel variable, and the paths of the k largest values are the sample.
They are found by A* search without listing paths. A path is a sequence of choices, made from the end of the text back: at
each node, one of the edges that arrive there, by the share of the node's paths that come over it. A search node is a set
of paths, namely fixed choices up to a place and some edges ruled out there; the largest perturbed value in it is a Gumbel
variable around the set's log mass, truncated at its parent's, and is drawn before the set is opened. Opening the best set
draws its best path (the edge at the place among those left, by their shares; the rest freely) and splits what remains
into disjoint sets, one for each place. The first unopened value after k paths is the threshold that gives each path its
inclusion score, 1 - exp(-exp(log p - threshold)). Nothing is drawn and thrown away, so no text takes more draws than it
has pieces.

Where no piece spans two neighbouring characters, every path has a node, so the lattice is a chain of short units. The
shares of a unit's edges are computed once and kept in tables of a bounded size while a task runs; all texts of a batch are
walked at once, one choice of every unit at a time. Texts are encoded whole. All draws are hashes of the seed, the row's
key and the place, so they depend on nothing else.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import give_back, need, tuned
from lodestone.llm.wordhash import mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: The model ranks its pieces; a piece of rank r weighs 1 / (r + RANK_OFFSET) ** sharpness. Bytes rank last.
RANK_OFFSET, SHARPNESS = 10, 1.5
#: Units of at most ``LONG`` characters are made many at a time; longer ones one by one, in logarithms.
LONG = 64
#: The tables of a task's units have so many edges (36 bytes each) and units; one batch may need more.
EDGES, UNITS = 3_000_000, 300_000
#: Texts encoded together: rows, and characters unless one text has more. What a task holds for them is some 400 bytes a character.
ROWS, CHARS = 200, 150_000
#: Cells of (unit, end, edge) that are worked on at once.
CELLS = 1 << 15

HASH_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
HASH_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Of a Gumbel variable made from 53 bits, -log(-log1p(-2^-54)) = 37.43.
HIGHEST, WIDE = 37.5, 96
SLOT_SHIFT = np.uint64(64 - 18)
STREAM, PLACE = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


class Unit:
    """A stretch of the lattice between two nodes that all paths share: its best path and that path's probability."""

    __slots__ = ("best", "p_best", "text")

    def __init__(self, text: str, best: tuple[int, ...], p_best: float):
        self.text, self.best, self.p_best = text, best, p_best


class Coded:
    """Texts as one run of characters, and where their units begin. Hashes of stretches are differences of ``sums``."""

    def __init__(self, pieces: Pieces, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
        self.codes, self.starts, self.sizes, self.counts = codes, starts, sizes, counts  # counts: units of each text
        self.up, down = pieces.powers(len(codes) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], dtype=np.uint64)])
        ends = starts + sizes
        #: Of each unit, a hash that isn't 0.
        self.keys = mixed((self.sums[ends] - self.sums[starts]) * self.up[ends - 1] + sizes.astype(np.uint64)) | np.uint64(1)

    def text(self, unit: int) -> str:
        return self.codes[self.starts[unit] : self.starts[unit] + self.sizes[unit]].tobytes().decode("utf-32-le", "surrogatepass")


class Units:
    """Tables of the units met so far, by a hash of their characters: nodes, and the edges that arrive at each, longest first.

    A unit of n characters has n nodes, one after each character; -1 stands for the node in front. ``till`` of an edge is
    the summed share of the node's edges up to it (2 at the last one); ``log_rest`` the log share of all others.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self, edges: int | None = None) -> None:
        edges = EDGES if edges is None else edges
        self.count = self.nodes = self.used = 0
        if edges and len(getattr(self, "till", ())) == edges and len(self.slots) == 4 * UNITS:
            self.slots[:] = 0  # begins anew in the same memory
            self.first[0] = 0
            return
        self.slots = self.slot_node = self.first = self.till = self.log_p = self.log_rest = self.before = self.id = None
        self.slots, self.slot_node = np.zeros(4 * UNITS if edges else 0, np.uint64), np.empty(4 * UNITS if edges else 0, np.int32)
        self.first = np.zeros(edges + 1, np.int32)
        self.till, self.log_p, self.log_rest = (np.empty(edges) for _ in range(3))
        self.before, self.id = (np.empty(edges, np.int32) for _ in range(2))

    def drop(self) -> None:
        """Gives the memory back; ``clear`` before the next use."""
        self.clear(0)

    def last_nodes(self, coded: Coded) -> np.ndarray:
        """Of each unit, its last node; units that aren't there are made. If they don't fit, the others go."""
        nodes = self._found(coded.keys)
        unknown = np.nonzero(nodes < 0)[0]
        if not len(unknown):
            return nodes
        fresh, first = np.unique(coded.keys[unknown], return_index=True)
        chars = int(coded.sizes[unknown[first]].sum())  # the edges of a character are about as many as so far
        if self.count and (self.used * (1 + 1.25 * chars / self.nodes) > EDGES or self.count + len(fresh) > UNITS):
            self.clear()
            unknown = np.arange(len(nodes))
            fresh, first = np.unique(coded.keys, return_index=True)
        for made in self.pieces.made(coded, unknown[first]):
            self._add(*made)
        nodes[unknown] = self._found(coded.keys[unknown])
        return nodes

    def _found(self, keys: np.ndarray) -> np.ndarray:
        out, size = np.full(len(keys), -1, np.int64), np.uint64(len(self.slots))
        slot, open_ = (keys % size).astype(np.int64), np.arange(len(keys))
        while len(open_):
            there = self.slots[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.slot_node[slot[hit]]
            more = ~hit & (there != 0)
            open_, slot = open_[more], (slot[more] + 1) % len(self.slots)
        return out

    def _put(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        if 2 * (self.count + len(keys)) > len(self.slots):  # a batch of very many units
            old, node = self.slots[self.slots != 0], self.slot_node[self.slots != 0]
            self.slots, self.slot_node, self.count = np.zeros(4 * (self.count + len(keys)), np.uint64), np.empty(4 * (self.count + len(keys)), np.int32), 0
            self._put(old, node)
        self.count += len(keys)
        slot = (keys % np.uint64(len(self.slots))).astype(np.int64)
        while len(keys):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = keys[free]
            own = self.slots[slot] == keys
            self.slot_node[slot[own]] = nodes[own]
            keys, nodes, slot = keys[~own], nodes[~own], (slot[~own] + 1) % len(self.slots)

    def _add(self, keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, share: np.ndarray, before: np.ndarray, ids: np.ndarray) -> None:
        """sizes: of each unit, its nodes; counts: of each node, its edges; before: as numbers within the unit."""
        n, m = len(counts), len(ids)
        if (short := max(self.used + m - len(self.till), self.nodes + n + 1 - len(self.first))) > 0:  # a batch with very long units
            for name in ("till", "log_p", "log_rest", "before", "id", "first"):
                setattr(self, name, np.concatenate([old := getattr(self, name), np.empty(max(short, len(old) // 2), old.dtype)]))
        base = self.nodes + np.cumsum(sizes) - sizes
        self._put(keys, base + sizes - 1)
        part = slice(self.used, self.used + m)
        rest, self.till[part] = summed(share, counts)
        self.id[part] = ids
        with np.errstate(divide="ignore"):
            self.log_p[part], self.log_rest[part] = np.log(share), np.log(rest)
        self.before[part] = np.where(before < 0, -1, before + np.repeat(np.repeat(base, sizes), counts))
        self.first[self.nodes + 1 : self.nodes + n + 1] = self.used + np.cumsum(counts)
        self.nodes, self.used = self.nodes + n, self.used + m

    def __getitem__(self, text: str) -> Unit:
        """The unit as the tables have it, with the best path; of equal ones that with the longest last piece."""
        end = int(self.last_nodes(self.pieces.as_unit(text))[0])
        top = {-1: (0.0, -1)}
        for node in range(end - len(text) + 1, end + 1):
            logs = [(top[int(self.before[e])][0] + float(self.log_p[e]), e) for e in range(self.first[node], self.first[node + 1])]
            high = max(logs)[0]
            top[node] = next(x for x in logs if x[0] > high - 1e-9)
        path, node = [], end
        while node >= 0:
            e = top[node][1]
            path.append(self.pieces.spelled(int(self.id[e])))
            node = int(self.before[e])
        return Unit(text, tuple(chain.from_iterable(reversed(path))), math.exp(top[end][0]))

    def walked(self, nodes: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node, edges back to the front of its unit, drawn by their shares: the edges one node after the other,
        and how many each has. stream: a hash for each node."""
        active, steps, counts = np.arange(len(nodes)), [], np.zeros(len(nodes), np.int64)
        while len(active):
            u = uniform(stream + PLACE * np.array([len(steps)], np.uint64))
            edge = self.first.take(nodes)
            over = np.nonzero(u >= self.till.take(edge))[0]
            while len(over):
                edge[over] += 1
                over = over[u.take(over) >= self.till.take(edge.take(over))]
            steps.append((active, edge))
            counts[active] += 1
            nodes = self.before.take(edge)
            more = np.nonzero(nodes >= 0)[0]
            active, nodes, stream = active.take(more), nodes.take(more), stream.take(more)
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for step, (which, edge) in enumerate(steps):
            out[at[which] + step] = edge
        return out, counts


def summed(share: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each edge, the shares of all others at its node and those up to it, added one by one; 2 up to the last one."""
    till, rest = share.copy(), np.zeros_like(share)
    last = np.cumsum(counts) - 1
    first = last - counts + 1
    after = np.zeros_like(share)
    for step in range(1, int(counts.max(initial=1))):
        many = np.nonzero(counts > step)[0]
        at = first[many] + step
        till[at] += till[at - 1]
        at = last[many] - step
        after[at] = after[at + 1] + share[at + 1]
    inner = np.ones(len(share), bool)
    inner[first] = False
    rest[inner] = till[np.nonzero(inner)[0] - 1]
    till[last] = 2.0
    return rest + after, till


def uniform(hashes: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1, 1 excluded, by hashes."""
    return (mixed(hashes) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Opened(NamedTuple):
    """A set whose best path is being drawn: the edges chosen, the nodes to walk from, of which the first is in unit ``begun``;
    the log share of what is left at its place, and the edges ruled out there."""

    text: int
    value: float
    edges: np.ndarray
    nodes: np.ndarray
    begun: int
    place: int
    rest: float
    ruled_out: tuple[int, ...]


class Pieces:
    """Vocabulary, weights and units. Built once a worker from the model's bytes."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, self.ids, self.bytes = self.processor, {}, {}
        size = sp.get_piece_size()
        for i in range(size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[sp.id_to_piece(i)] = i
        self.byte_runs: list[tuple[int, ...]] = []  # ids of characters without a piece
        self.byte_run: dict[str, int] = {}
        self.written = np.array([None] * size, object)  # what a piece adds to a text; None for bytes of longer characters
        for p, i in self.ids.items():
            self.written[i] = p.replace(SPACE, " ")
        for b in range(128):
            self.written[self.bytes[b]] = chr(b)
        first = min(self.ids.values())
        self.weight = {p: 1000.0 / (i - first + RANK_OFFSET) ** sharpness for p, i in self.ids.items()}
        self.byte_weight = 1000.0 / (size + RANK_OFFSET) ** sharpness
        self.longest = max(map(len, self.ids))
        # Characters get numbers, 0 for those in no piece; joined[a, b]: some piece has b right after a.
        chars = sorted({c for p in self.ids for c in p})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.ids:
            at = self.number[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        # Pieces by their hashes: a table with free slots between; a piece whose slot is taken goes to the next free one.
        self.weight_at, self.id_at = np.array([0.0, *self.weight.values()]), np.array([0, *self.ids.values()], np.int32)
        self.known, self.known_place = np.zeros(1 << (64 - int(SLOT_SHIFT)), np.uint64), np.zeros(1 << (64 - int(SLOT_SHIFT)), np.int32)
        for place, h in enumerate(self._hashes(list(self.ids)).tolist(), 1):
            slot = h >> int(SLOT_SHIFT)
            while self.known[slot]:
                slot = (slot + 1) % len(self.known)
            self.known[slot], self.known_place[slot] = h, place
        self._powers = (np.ones(0, np.uint64),) * 2
        self.units = Units(self)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of HASH_BASE and of its inverse modulo 2^64."""
        if len(self._powers[0]) < n:
            self._powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64), dtype=np.uint64)]) for base in (HASH_BASE, HASH_INVERSE))
        return self._powers

    def _hashes(self, texts: list[str]) -> np.ndarray:
        """Hashes of pieces: polynomials of their characters' codes."""
        out = []
        for text in texts:
            h = 0
            for c in text:
                h = (h * int(HASH_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return mixed(np.array(out, np.uint64))

    def located(self, texts: list[str]) -> Coded:
        """The texts' units. Spaces are written as the model writes them, with one more in front."""
        # A literal U+2581 is none of the model's spaces: it stands as a lone surrogate, outside all pieces.
        plain = [SPACE + t.replace(SPACE, "\ud800").replace(" ", SPACE) if t else "" for t in texts]
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *map(len, plain)])
        number = self.number[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.joined[number[:-1], number[1:]]
        cut[begins[:-1][begins[:-1] < len(codes)]] = True
        starts = np.nonzero(cut)[0]
        return Coded(self, codes, starts, np.diff(starts, append=len(codes)), np.diff(np.searchsorted(starts, begins)))

    def as_unit(self, *units: str) -> Coded:
        """Given units, for the tables."""
        sizes = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        return Coded(self, codes, np.cumsum(sizes) - sizes, sizes, sizes)

    def split(self, text: str) -> list[str]:
        """The units of a text, in order."""
        coded = self.located([text])
        return [coded.text(i) for i in range(len(coded.starts))]

    def learn(self, texts: set[str]) -> None:
        """Makes these units, as far as they aren't there."""
        self.units.last_nodes(self.as_unit(*texts))

    def spelled(self, i: int) -> tuple[int, ...]:
        """The piece ids of an edge's number: a piece, or below 0 the bytes of a character."""
        return (i,) if i >= 0 else self.byte_runs[-i - 1]

    def spelled_out(self, ids: np.ndarray) -> np.ndarray:
        """``ids`` with the bytes of characters in place of their numbers."""
        at = np.nonzero(ids < 0)[0]
        runs = list(map(self.byte_runs.__getitem__, (-ids[at] - 1).tolist()))
        sizes = np.ones(len(ids), np.int64)
        sizes[at] = list(map(len, runs))
        out = np.repeat(ids, sizes)
        out[np.repeat(ids < 0, sizes)] = np.fromiter(chain.from_iterable(runs), np.int32)
        return out

    def byte_edge(self, char: str) -> tuple[int, float]:
        """(number, weight) of the edge of a character without a piece: its only byte, or a number below 0 for its bytes."""
        raw = (SPACE if char == "\ud800" else char).encode("utf-8", "replace")
        if len(raw) == 1:
            number = self.bytes[raw[0]]
        elif (number := self.byte_run.get(char)) is None:
            self.byte_runs.append(tuple(self.bytes[b] for b in raw))
            number = self.byte_run[char] = -len(self.byte_runs)
        return number, self.byte_weight ** len(raw)

    def made(self, coded: Coded, units: np.ndarray) -> Iterator[tuple]:
        """What ``Units`` keeps of the units with these numbers: those of one length together."""
        units = units[np.argsort(coded.sizes[units], kind="stable")]
        sizes = coded.sizes[units]
        for n in np.unique(sizes).tolist():
            group = units[np.searchsorted(sizes, n) : np.searchsorted(sizes, n, side="right")]
            many = max(1, CELLS // (n * min(n, self.longest))) if n <= LONG else 1
            for at in range(0, len(group), many):
                yield self._alike(coded, group[at : at + many], n) if n <= LONG else self._long(coded, group[at : at + 1])

    def _alike(self, coded: Coded, units: np.ndarray, n: int) -> tuple:
        """Units of n characters as cells [unit, end, edge], where the last edge has one character, the one before two, ..."""
        g, width = len(units), min(n, self.longest)
        places = coded.starts[units][:, None] + np.arange(n + 1)
        sums, up = coded.sums[places], coded.up[places[:, :-1]]
        piece = np.zeros((g, n, width), np.int32)  # places in ``id_at``, or below 0 places in ``odd``
        odd = [0]
        for size in range(1, width + 1):
            h = mixed((sums[:, size:] - sums[:, :-size]) * up[:, size - 1 :])
            slot = (h >> SLOT_SHIFT).astype(np.int64)
            there = self.known.take(slot)
            hit = there == h
            piece[:, size - 1 :, width - size] = np.where(hit, self.known_place.take(slot), 0)
            again = np.nonzero((there != 0) & ~hit)
            slot, h = slot[again], h[again]
            while len(h):
                slot = (slot + 1) % len(self.known)
                there = self.known[slot]
                hit = there == h
                piece[again[0][hit], again[1][hit] + size - 1, width - size] = self.known_place[slot[hit]]
                more = (there != 0) & ~hit
                slot, h, again = slot[more], h[more], (again[0][more], again[1][more])
        weight = self.weight_at.take(piece)
        for unit, end in zip(*(x.tolist() for x in np.nonzero(piece[:, :, -1] == 0)), strict=True):
            made, weight[unit, end, -1] = self.byte_edge(chr(coded.codes[places[unit, end]]))
            piece[unit, end, -1] = -len(odd)
            odd.append(made)
        # ahead: the summed weight of all paths to a node; weight becomes the weight of the paths that come over an edge.
        ahead = np.zeros((g, width + n))
        ahead[:, width - 1] = 1.0
        for end in range(n):
            weight[:, end] *= ahead[:, end : end + width]
            ahead[:, width + end] = weight[:, end].sum(1)
        at = np.nonzero(piece.ravel())[0]
        node, edge = np.divmod(at, width)
        share = weight.ravel()[at] / ahead[:, width:].ravel()[node]
        counts = np.bincount(node, minlength=g * n)
        number = piece.ravel()[at]
        number = np.where(number > 0, self.id_at[np.maximum(number, 0)], np.array(odd, np.int32)[np.maximum(-number, 0)])
        return coded.keys[units], np.full(g, n), counts, share, node % n - (width - edge), number

    def _long(self, coded: Coded, units: np.ndarray) -> tuple:
        """The same for one unit in logarithms, where products could leave a float's range."""
        text = coded.text(units[0])
        n = len(text)
        ahead, counts, before, ids, shares = [0.0], [], [], [], []
        for end in range(1, n + 1):
            options = [(at, self.ids[p], math.log(self.weight[p])) for at in range(max(0, end - self.longest), end) if (p := text[at:end]) in self.weight]
            if not options or options[-1][0] != end - 1:
                number, w = self.byte_edge(text[end - 1])
                options.append((end - 1, number, math.log(w)))
            logs = [ahead[at] + w for at, _, w in options]
            high = max(logs)
            ahead.append(high + math.log(math.fsum(math.exp(x - high) for x in logs)))
            share = [math.exp(x - ahead[-1]) for x in logs]
            counts.append(len(options))
            before += [at - 1 for at, _, _ in options]
            ids += [i for _, i, _ in options]
            shares += share
        return coded.keys[units], np.array([n]), np.array(counts), np.array(shares), np.array(before), np.array(ids, np.int32)

    def edges(self, text: str, at: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """(node reached, piece ids, weight) of the edges from a node. A character without a piece is its bytes."""
        weight, found = self.weight, False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            if (w := weight.get(piece := text[at:end])) is not None:
                found |= end == at + 1
                yield end, (self.ids[piece],), w
        if not found:
            number, w = self.byte_edge(text[at])
            yield at + 1, self.spelled(number), w

    def unit(self, text: str) -> Unit:
        """The unit's best path by itself, in time linear in its length; in logarithms."""
        n = len(text)
        sums: list[list[float]] = [[] for _ in range(n + 1)]
        ahead, top, came = [0.0] + [-math.inf] * n, [0.0] + [-math.inf] * n, [(0, ())] * (n + 1)
        for at in range(n + 1):
            if at:
                high = max(sums[at])
                ahead[at] = high + math.log(math.fsum(math.exp(x - high) for x in sums[at]))
            for end, got, w in self.edges(text, at) if at < n else ():
                step = math.log(w)
                sums[end].append(ahead[at] + step)
                if top[at] + step > top[end]:
                    top[end], came[end] = top[at] + step, (at, got)
        path, node = [], n
        while node:
            node, got = came[node]
            path.append(got)
        return Unit(text, tuple(chain.from_iterable(reversed(path))), math.exp(top[n] - ahead[n]))

    def sampled_together(self, coded: Coded, k: int, keys: np.ndarray) -> list[tuple[list[dict], float]]:
        """Of each text, up to ``k`` distinct segmentations in the order of their perturbed values, and the threshold after them.

        keys: a 64-bit hash of each text's row key.
        """
        units = self.units
        # The nodes that walks start from: each unit's last one, from the end of the text to its beginning.
        nodes, till = units.last_nodes(coded), np.cumsum([0, *coded.counts])
        ends = [nodes[a:b][::-1] for a, b in zip(till, till[1:], strict=False)]
        found: list[list[dict]] = [[] for _ in ends]
        # Sets: minus the largest perturbed value, a running number, the parent's edges, the place, the edges ruled out there.
        first = np.log(-np.log1p(-uniform(keys + STREAM) - 2.0**-54)).tolist()
        heaps: list[list[tuple]] = [[(x if len(own) else 0.0, 0, None, -1, ())] for own, x in zip(ends, first, strict=True)]
        for number in range(1, k + 1):
            streams = mixed(keys ^ mixed(np.full(1, number, np.uint64)))
            dice = uniform(streams - PLACE).tolist()
            opened = [self._opened(ends[text], text, heapq.heappop(heap), dice[text]) for text, heap in enumerate(heaps) if heap and (number == 1 or len(ends[text]))]
            if not opened:
                break
            which = np.array([x.text for x in opened])
            sizes = np.array([len(x.nodes) for x in opened])
            unit = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - [x.begun for x in opened], sizes)
            drawn, counts = units.walked(np.concatenate([x.nodes for x in opened]), mixed(np.repeat(streams[which], sizes) + STREAM * unit.astype(np.uint64)))
            till = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
            everything = [np.concatenate([x.edges, drawn[a:b]]) if len(x.edges) else drawn[a:b] for x, a, b in zip(opened, till, till[1:], strict=False)]
            flat = np.concatenate(everything)
            log_p, ids = units.log_p.take(flat), units.id.take(flat)
            at = np.cumsum([0, *map(len, everything)]).tolist()
            sets = self._next_sets(opened, everything, log_p, at, mixed(streams[which] + PLACE), k + 1)
            for x, edges, a, b, more in zip(opened, everything, at, at[1:], sets, strict=False):
                found[x.text].append({"ids": ids[a:b][::-1], "log_p": float(log_p[a:b].sum()), "value": x.value})
                heap = heaps[x.text]
                for score, i in more[: k - len(found[x.text]) + 1]:
                    lower = -x.value + math.log1p(math.exp(-abs(score - x.value))) if score > x.value else -score + math.log1p(math.exp(-abs(score - x.value)))
                    heapq.heappush(heap, (lower, len(heap) + number * (k + 2), edges, i, x.ruled_out if i == x.place else (int(edges[i]),)))
        out = []
        for heap, rows in zip(heaps, found, strict=True):
            threshold = -heap[0][0] if heap else -math.inf
            for x in rows:
                if len(x["ids"]) and x["ids"].min() < 0:
                    x["ids"] = self.spelled_out(x["ids"])
                x["inclusion"] = -math.expm1(-math.exp(min(700.0, x["log_p"] - threshold))) if threshold > -math.inf else 1.0
            out.append((rows, threshold))
        return out

    def _opened(self, ends: np.ndarray, text: int, popped: tuple, die: float) -> Opened:
        """A set as far as its best path is chosen before the free walks."""
        units, (value, _, edges, place, ruled_out) = self.units, popped
        if place < 0:
            return Opened(text, -value, ends[:0], ends, 0, -1, -math.inf, ())
        begun = int(np.count_nonzero(units.before[edges[:place]] < 0))  # units that are chosen whole
        node = int(units.before[edges[place - 1]]) if place else -1
        node = int(ends[begun]) if node < 0 else node
        begin, end = units.first[node : node + 2].tolist()
        left = [(e, p) for e, p in zip(range(begin, end), np.exp(units.log_p[begin:end]).tolist(), strict=True) if e not in ruled_out]
        u, pick = die * math.fsum(p for _, p in left), len(left) - 1
        for i, (_, p) in enumerate(left[:-1]):
            if u < p:
                pick = i
                break
            u -= p
        chosen, _ = left.pop(pick)
        inside, rest = int(units.before[chosen]), math.fsum(p for _, p in left)
        nodes = ends[begun + 1 :] if inside < 0 else np.concatenate([[inside], ends[begun + 1 :]])
        return Opened(text, -value, np.append(edges[:place], chosen), nodes, begun + (inside < 0), place, math.log(rest) if rest else -math.inf, (*ruled_out, chosen))

    def _next_sets(self, opened: list[Opened], edges: list[np.ndarray], log_p: np.ndarray, at: list[int], streams: np.ndarray, many: int) -> list[list[tuple[float, int]]]:
        """What is left of each opened set, as sets: the same choices up to a place from its own on, and another edge there. The
        ``many`` with the largest Gumbel variables around their log masses, as (variable, place).

        Masses only fall from place to place and a variable is at most ``HIGHEST`` above, so the first places mostly do; the
        other texts are searched on.
        """
        begin = np.array([max(x.place, 0) for x in opened])
        ahead = np.array([log_p[a : a + b].sum() for a, b in zip(at, begin.tolist(), strict=False)])
        size = np.array([len(e) for e in edges]) - begin
        many = min(many, WIDE)
        out = [[] for _ in opened]
        todo = np.nonzero(size > 0)[0]
        start, done = np.array(at[:-1]) + begin, 0
        flat = np.concatenate(edges)
        while len(todo):
            place = done + np.arange(WIDE)
            inside = place < size[todo][:, None]
            where = np.where(inside, start[todo][:, None] + place, start[todo][:, None])
            step = np.where(inside, log_p[where], 0.0)
            sums = ahead[todo][:, None] + np.cumsum(step, 1)
            rest = self.units.log_rest[flat[where]]
            if not done:
                rest[:, 0] = np.where([opened[i].place >= 0 for i in todo], [opened[i].rest for i in todo], rest[:, 0])
            hashes = streams[todo][:, None] + PLACE * (begin[todo][:, None] + place).astype(np.uint64)
            score = np.where(inside, sums - step + rest, -np.inf) - np.log(-np.log1p(-uniform(hashes) - 2.0**-54))
            top = np.argpartition(-score, many - 1, 1)[:, :many] if many < WIDE else np.broadcast_to(np.arange(WIDE), score.shape)
            best = np.take_along_axis(score, top, 1).tolist()
            ahead[todo] = sums[:, -1]
            done += WIDE
            more = []
            for i, values, places, left in zip(todo.tolist(), best, top.tolist(), sums[:, -1].tolist(), strict=True):
                got = [(v, int(begin[i]) + done - WIDE + p) for v, p in zip(values, places, strict=True) if v > -math.inf]
                out[i] = sorted(out[i] + got, key=lambda x: (-x[0], x[1]))[:many]
                if done < size[i] and (len(out[i]) < many or left + HIGHEST > out[i][-1][0]):
                    more.append(i)
            todo = np.array(more, np.int64)
        return out

    def sampled(self, text: str, k: int, random: np.random.Generator) -> tuple[list[dict], float]:
        """``sampled_together`` of one text, with a key drawn from ``random`` and the ids as lists."""
        found, threshold = self.sampled_together(self.located([text]), k, random.integers(0, 1 << 64, 1, np.uint64, False))[0]
        return [x | {"ids": x["ids"].tolist()} for x in found], threshold

    def encoded(self, text: str) -> list[int]:
        """The most probable segmentation."""
        best: dict[str, tuple[int, ...]] = {}
        for u in (units := self.split(text)):
            if u not in best:
                best[u] = self.unit(u).best
        return list(chain.from_iterable(map(best.__getitem__, units)))

    def decoded(self, ids: list[int]) -> str:
        """The text of piece ids, by the model itself."""
        return self.processor.decode(ids)

    def gives(self, ids: np.ndarray, text: str) -> bool:
        """Whether decoding the ids gives the text: pieces stand for themselves, a space in front goes, bytes are the model's to decode."""
        parts = self.written.take(ids).tolist()
        if None in parts:
            return self.decoded(ids.tolist()) == text
        return "".join(parts)[1:] == text


def read_model(path: str = MODEL) -> bytes:
    """The model file, read on the driver and sent to the tasks (a vocabulary, a few megabytes)."""
    with open(path, "rb") as f:
        return f.read()


def _worker(shared, sharpness: float) -> Pieces:
    """The vocabulary, one of each Python worker whatever tasks it runs. What it knows of units goes with the task."""
    import sys
    import types

    home = sys.modules.setdefault("_lodestone_pieces", types.ModuleType("_lodestone_pieces"))
    key = (hashlib.sha256(shared.value).digest(), sharpness)
    if getattr(home, "key", None) != key:
        home.key, home.pieces = key, Pieces(shared.value, sharpness)
    return home.pieces


def ids_digest(ids: np.ndarray) -> str:
    """sha256 of the ids as little-endian 32-bit numbers."""
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 3, seed: int = 11, sharpness: float = SHARPNESS, model_path: str = MODEL, digest: bool = False) -> DataFrame:
    """(id, sample, ids array<int>, n_pieces, log_prob, perturbed, inclusion, round_trip): up to ``k`` rows a row of ``docs``.

    ``ids`` is their sha256 (string) with ``digest``. Samples count from 1 in the order of their perturbed values; there
    are fewer than k if the text has fewer segmentations. round_trip: decoding gives the text again. Null and empty
    texts have one segmentation, without pieces. The row key is the id's decimal text (null: ''), so rows that repeat
    an id and its text give the same samples. Other columns are not read.
    """
    spark = tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_model(model_path))
    names = ["id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        give_back()  # of earlier stages' tasks
        pieces = _worker(shared, sharpness)
        pieces.units.clear()
        kinds = (pa.int32(), pa.string() if digest else pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
        try:
            for batch in batches:
                texts, keys, begin = [t or "" for t in batch.column(2).to_pylist()], batch.column(1).to_pylist(), 0
                while begin < len(texts):
                    end, chars = begin, 0
                    while end < len(texts) and end - begin < ROWS and (end == begin or chars + len(texts[end]) <= CHARS):
                        chars += len(texts[end])
                        end += 1
                    hashes = np.array([xxhash.xxh3_64_intdigest(key.encode(), seed=seed) for key in keys[begin:end]], np.uint64)
                    owner: list[int] = []
                    out: list[list] = [[] for _ in kinds]
                    for row, (found, _) in enumerate(pieces.sampled_together(pieces.located(texts[begin:end]), k, hashes), begin):
                        for number, x in enumerate(found, 1):
                            ids = x["ids"].astype(np.int32, copy=False)
                            owner.append(row)
                            row_out = (number, ids_digest(ids) if digest else ids, len(ids), x["log_p"], x["value"], x["inclusion"], pieces.gives(ids, texts[row]))
                            for column, v in zip(out, row_out, strict=True):
                                column.append(v)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *(pa.array(c, kind) for c, kind in zip(out, kinds, strict=True))], names=names)
                    begin = end
        finally:
            pieces.units.drop()  # the worker lives on and serves other stages
            give_back()

    rows = need(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, sample int, ids {'string' if digest else 'array<int>'}, n_pieces bigint, log_prob double, perturbed double, inclusion double, round_trip boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(text: Column, spark, model_path: str = MODEL, sharpness: float = SHARPNESS) -> Column:
    """Ids of the most probable segmentation of a string column; null stays null."""
    shared = spark.sparkContext.broadcast(read_model(model_path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def best(texts: pa.Array) -> pa.Array:
        pieces = _worker(shared, sharpness)
        return pa.array([None if t is None else pieces.encoded(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return best(text)


def decode(ids: Column, spark, model_path: str = MODEL) -> Column:
    """The text of an array of piece ids; null stays null."""
    shared = spark.sparkContext.broadcast(read_model(model_path))

    @F.arrow_udf(T.StringType())
    def texts(rows: pa.Array) -> pa.Array:
        pieces = _worker(shared, SHARPNESS)
        return pa.array([None if r is None else pieces.decoded(r) for r in rows.to_pylist()], pa.string())

    return texts(ids)
