import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, linededup, simhash, substring
from tests_llm_shared import TEXTS


def brute_components(nodes, near):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint").repartition(5)).collect()}
    nodes = {n for e in edges if None not in e and e[0] != e[1] for n in e}
    linked = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    assert got == brute_components(sorted(nodes), lambda a, b: (a, b) in linked)
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def brute_fingerprint(text):
    import re

    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, edge):
    got = {r.doc_id: r for r in simhash.near_duplicates(edge, shingle_words=3).withColumn("hex", simhash.as_hex(F.col("fp"))).collect()}
    prints = {i: brute_fingerprint(t) for i, t in TEXTS.items()}
    assert all(got[i].hex == f"{p:016x}" for i, p in prints.items())
    want = brute_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    assert {i: got[i].component_id for i in prints} == want
    assert got[4].component_id == got[5].component_id == got[6].component_id == 4  # no words: linked like any other


@pytest.mark.parametrize(("crowd", "max_bits"), [(256, 3), (16, 3), (8, 2)])
def test_links_are_all_close_pairs_however_crowded(spark, crowd, max_bits):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 63))
    values = {centre}
    while len(values) < 120:  # many within a few bits of one another
        values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    values = sorted(values | {int(x) for x in rng.integers(0, 1 << 63, 60)})
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "node bigint, fp bigint")
    got = {tuple(sorted((r.src, r.dst))) for r in simhash.links(nodes, max_bits, crowd).collect()}
    want = {(a, b) for a in range(len(values)) for b in range(a) if bin(values[a] ^ values[b]).count("1") <= max_bits}
    assert got == {tuple(sorted(p)) for p in want}


def test_simhash_keeps_one_of_each_group(spark, edge, empty):
    kept = simhash.keep_first(edge, shingle_words=5)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 4 in ids and 5 not in ids and None in ids and 9 in ids
    assert simhash.near_duplicates(empty).count() == 0


def close(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_lines(docs, min_chars):
    """{id: text} with the lines of later documents taken out."""
    seen, out = [], {}
    for i in sorted(docs):
        kept = []
        for line in docs[i].split("\n"):
            known = [x for x in seen if x == line or (len(x) >= min_chars <= len(line) and close(x, line))]
            if line.strip() and known:
                if line not in seen:
                    seen.append(line)
                continue
            kept.append(line)
            if line.strip():
                seen.append(line)
        out[i] = "\n".join(kept)
    return out


def test_lines(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab ") for _ in range(rng.randrange(3, 40))) for _ in range(40)]
    for line in list(lines):
        at = rng.randrange(len(line))
        lines += [line[:at] + "c" + line[at:], line[:at] + line[at + 1 :], line[:at] + "d" + line[at + 1 :], line[:at] + "é" + line[at:] + "z"]
    docs = {i: "\n".join(rng.choice(lines) for _ in range(6)) for i in range(60)}
    got = {r.doc_id: r.text for r in linededup.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4), min_chars=10).collect()}
    assert got == brute_lines(docs, 10)


def test_lines_of_odd_documents(spark, edge, empty):
    out = linededup.deduplicated(edge)
    assert out.columns == [*edge.columns, "n_lines", "n_removed"] and out.count() == edge.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[12].text == "other" and got[15].text == "end" and got[12].n_removed == 1  # the same line, and one an edit apart
    assert got[4].text is None and got[4].n_lines == 0 and got[5].text == "" and got[6].text == "  \n\t " and got[2].text == ""
    assert linededup.deduplicated(empty).count() == 0
    with pytest.raises(ValueError):
        linededup.deduplicated(edge, max_edits=2)


def test_exact_lines_only(spark, edge):
    got = {r.doc_id: r.text for r in linededup.deduplicated(edge, max_edits=0).collect()}
    assert got[12] == "other" and got[15].startswith("shared")


def test_compact_windows_cover_every_run():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 120).astype(np.uint64)
    windows = substring.compact_windows(values, 10)
    for i in range(120):
        for j in range(i + 9, 120):
            own = [(l, c, r) for l, c, r in windows if l <= i <= c <= j <= r]
            assert len(own) == 1 and values[own[0][1]] == values[i : j + 1].min()


def passages_of(docs, least=50):
    where = {}
    for i, words in docs.items():
        for at in range(len(words) - least + 1):
            where.setdefault(tuple(words[at : at + least]), set()).add(i)
    return where


def test_repeated_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [[word() for _ in range(n)] for n in (51, 60, 140)]
    docs = {i: [word() for _ in range(rng.randrange(20, 200))] for i in range(40)}
    for i in range(0, 40, 3):
        at = rng.randrange(len(docs[i]))
        docs[i][at:at] = shared[i % len(shared)] if i % 2 else shared[0] + shared[2]
    near = list(shared[2])
    near[30], near[90] = "changed", "too"
    docs[100] = [word() for _ in range(30)] + near
    got = {r.doc_id: r for r in substring.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string").repartition(4)).collect()}
    for passage, ids in passages_of(docs).items():
        if len(ids) > 1:
            assert len({got[i].class_id for i in ids}) == 1
    for i, words in docs.items():
        covered = {p for at in range(len(words) - 49) if len(passages_of(docs)[tuple(words[at : at + 50])]) > 1 for p in range(at, at + 50)} if i % 3 == 0 else set()
        marked = {p for s in got[i].spans for p in range(s.begin, s.end)}
        assert covered <= marked and (covered or i in (100,) or not marked)
    assert got[100].n_repeated >= 130 and got[100].linked_to  # a near copy


def test_passages_of_odd_documents(spark, edge, empty):
    got = {r.doc_id: r for r in substring.repeated(edge).collect()}
    assert got[10].linked_to == [9] and got[10].class_id == 9 and got[9].n_repeated == 6000 and got[9].n_links == 0
    assert got[4].n_words == 0 and got[7].class_id == 7 and got[None].class_id is None and len(got) == len(TEXTS) + 1
    assert substring.repeated(empty).count() == 0


def test_passages_with_a_word_more_or_less(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = []
    for i in range(100):
        one = [word() for _ in range(51)]
        two = list(one)
        at = rng.randrange(5, 46)
        two[at : at + i % 2] = [] if i % 2 else [word()]
        for k, passage in enumerate((one, two)):
            docs.append((2 * i + k, " ".join([word() for _ in range(70)] + passage + [word() for _ in range(70)])))
    got = {r.doc_id: r.class_id for r in substring.repeated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    least = substring.LEAST_WORDS - substring.SHINGLE + 1
    near = [i for i in range(0, 200, 2) if all(substring.alike(a, b, least, 0.8) for a, b in [[substring.shingles_of(docs[i + k][1].encode()) for k in (x, 1 - x)] for x in (0, 1)])]
    assert len(near) >= 90 and sum(got[i] == got[i + 1] for i in near) >= 0.97 * len(near)


def test_families_around_a_common_phrase_all_meet(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    phrase, docs = [word() for _ in range(40)], []
    for family in range(20):
        passage = [word() for _ in range(6)] + phrase + [word() for _ in range(6)]
        docs += [(2 * family + k, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])) for k in range(2)]
    got = {r.doc_id: r for r in substring.repeated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert all(got[i].class_id == got[i + 1].class_id == i and got[i].n_repeated == 52 for i in range(0, 40, 2))


def test_longer_partner_after_a_shorter_first_one(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = []
    for family in range(40):
        passage = [word() for _ in range(60)]
        for k in range(3):  # the first has 50 of the 60 words only
            docs.append((3 * family + k, " ".join([word() for _ in range(40)] + passage[: 60 if k else 50] + [word() for _ in range(40)])))
    got = {r.doc_id: r.n_repeated for r in substring.repeated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == {i: 60 if i % 3 else 50 for i in range(120)}


def test_rows_without_an_id_bridge_and_get_a_component(spark):
    words = [f"word{i}" for i in range(400)]
    near = list(words)
    rows = [(1, " ".join(words)), (None, " ".join(words)), (None, "alone here without any other row of its kind")]
    for at in range(400):  # a text a bit or two away, without an id
        near[at] = "other"
        if 0 < bin((brute_fingerprint(" ".join(near)) ^ brute_fingerprint(" ".join(words)))).count("1") <= 3:
            break
    rows.append((None, " ".join(near)))
    got = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=3).select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (None, 1), (None, 1), (None, None)], key=str)


def test_many_removed_lines_of_a_long_text(spark):
    lines = [f"line number {i % 700} of a long text that goes on" for i in range(30_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "x" * 120_000 + "\n" + lines[0])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in linededup.deduplicated(docs, max_edits=0).collect()}
    assert got[1].text == "\n".join(lines[:700]) and got[1].n_removed == 29_300 and got[2].text == "x" * 120_000


@pytest.mark.parametrize("common", [1, 5, 20_000])
def test_common_and_rare_lines_lose_the_same(spark, monkeypatch, common):
    rng = random.Random(7)
    lines = [f"a line of some length with the number {n} in it" for n in range(30)]
    rows = [(i, "\n".join(rng.choice(lines[: 3 if i % 2 else 30]) for _ in range(6))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, lines[0]), (61, None)], "doc_id bigint, text string")
    seen, want = {lines[0]}, {None: lines[0], 61: None}  # a row without an id comes first
    for i, text in rows:
        kept = [x for x in text.split("\n") if not (x in seen or seen.add(x))]
        want[i] = "\n".join(kept)
    monkeypatch.setattr(linededup, "COMMON", common)
    assert {r.doc_id: r.text for r in linededup.deduplicated(docs, max_edits=0).collect()} == want


def test_windows_of_a_text_of_one_word():
    rows = sum(b.num_rows for b in substring._windows(46, 4)(iter([pa.RecordBatch.from_pydict({"doc": [1], "text": ["word " * 100_000]})])))
    assert 4 * 2_000 < rows <= 4 * 3 * 5_000  # one for half a run and group, not one a word
    same = substring.untied(np.array([3, 1, 1, 1, 2], np.uint64))
    assert sorted(same.tolist()) == list(range(5)) and same[0] == 4 and same[4] == 3


def test_shingles_near_their_places():
    rng = np.random.default_rng(3)
    for shift in (-40, -3, 0, 25):
        a, b = rng.integers(0, 30, 80).astype(np.uint32), rng.integers(0, 30, 120).astype(np.uint32)
        want = [any(b[q] == a[p] for q in range(len(b)) if abs(q - p - shift) <= substring.SLACK) for p in range(80)]
        assert substring.near_places(a, b, shift).tolist() == want


def test_windows_that_part_at_the_same_shingle_meet_again():
    phrase = np.arange(100, 130, dtype=np.uint32)
    one, two, first = (np.concatenate([np.full(20, x, np.uint32), phrase, np.full(20, y, np.uint32)]) for x, y in ((1, 2), (1, 3), (8, 9)))
    at = np.array([35 << 2 * substring.REACH_BITS | 30 << substring.REACH_BITS | 30])
    got = [set(substring.parted(a, first, 0, [], np.array([77]), at, 0)[0].tolist()) for a in (one, two)]
    assert len(got[0]) == len(got[1]) == 2 and len(got[0] & got[1]) == 1  # alike on the left only
    assert len(substring.parted(one, first, 0, [(5, 65)], np.array([77]), at, 0)[0]) == 0  # covered whole


def test_wide_nodes_of_many_texts_are_the_trees_nodes():
    random = np.random.default_rng(5)
    for least in (1, 2, 7, 46):
        texts = [random.integers(1, 1 << 62, n).astype(np.uint64) for n in (least, 300, least + 1, 95)] + [np.resize(random.integers(1, 1 << 62, 5).astype(np.uint64), 120)]
        for f, (text, value, _, at) in enumerate(substring._nodes(texts, least, 2)):
            got = {(int(t), int(v), int(a)) for t, v, a in zip(text, value, at, strict=True)}
            assert len(got) == len(text)
            for i, shingles in enumerate(texts[:4]):
                hashed = substring.function(shingles, f)
                want = {(i, int(hashed[c].view(np.int64)), c << 24 | min(c - low, least - 1) << 12 | min(high - c, least - 1)) for low, c, high in substring.compact_windows(hashed, least)}
                assert {g for g in got if g[0] == i} == want
            hashed = substring.function(texts[4], f)
            nodes = {c: (int(hashed[c].view(np.int64)), min(c - low, least - 1), min(high - c, least - 1)) for low, c, high in substring.compact_windows(substring.untied(hashed), least)}
            repeated = {a >> 24: (v, a >> 12 & 4095, a & 4095) for t, v, a in got if t == 4}
            assert repeated and all(nodes[c] == w for c, w in repeated.items())


def test_nodes_split_over_groups_of_texts_are_the_same(monkeypatch):
    texts = {"doc": list(range(40)), "text": [" ".join(f"w{(i * k) % 997}" for k in range(80 + i)) for i in range(1, 41)]}
    whole = pa.Table.from_batches(list(substring._windows(46, 4)(iter([pa.RecordBatch.from_pydict(texts)]))))
    monkeypatch.setattr(substring, "NODES", 7)
    monkeypatch.setattr(substring, "TOGETHER", 300)
    parts = pa.Table.from_batches(list(substring._windows(46, 4)(iter([pa.RecordBatch.from_pydict(texts)]))))
    rows = [set(zip(*t.to_pydict().values(), strict=True)) for t in (whole, parts)]
    assert rows[0] == rows[1] and len(rows[0]) == whole.num_rows


def test_stretches_judged_together_are_as_each_by_itself(monkeypatch):
    """The batch form against the definitions for one pair: ``alike`` and ``parted``."""
    random_ = np.random.default_rng(11)
    least = 20
    rows = []
    for i in range(120):
        a = random_.integers(0, 1 << 32, random_.integers(1, 150)).astype(np.uint32)
        b = np.delete(a, random_.integers(0, len(a), i % 4)) if i % 3 else random_.integers(0, 30, 90).astype(np.uint32)
        if i % 7 == 0:
            a, b = np.resize(a[:5], 80), np.resize(a[:5], 61)
        if i % 5 == 0:
            b = np.concatenate([random_.integers(0, 1 << 32, 25).astype(np.uint32), b, a[:10]])
        lo, to_lo = (int(x) for x in random_.integers(0, 500, 2))
        shift = int(random_.integers(-3, 28)) if i % 5 else 25
        at = [int(lo + c) << 24 | int(random_.integers(0, least)) << 12 | int(random_.integers(0, least)) for c in random_.integers(-5, len(a) + 5, 6)]
        at = [x for x in at if x >= 0]
        rows.append((i, i + 1000, lo - shift - to_lo, lo, to_lo, a.tobytes(), b.tobytes(), [{"key": int(k), "at": x} for k, x in zip(random_.integers(-1 << 60, 1 << 60, len(at)), at, strict=True)]))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int64())]))]
    names = ["doc", "to_doc", "diagonal", "lo", "to_lo", "one", "two", "windows"]
    batch = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    monkeypatch.setattr(substring, "TOGETHER", 2_000)
    got = pa.Table.from_batches(list(substring._verified(least, 0.8)(iter([batch])))).to_pylist()
    assert len(got) == len(rows) and sum(bool(g["spans"]) for g in got) > 20
    for g, (doc, to_doc, diagonal, lo, to_lo, one, two, windows) in zip(got, rows, strict=True):
        a, b, shift = np.frombuffer(one, np.uint32), np.frombuffer(two, np.uint32), lo - diagonal - to_lo
        there, here = substring.alike(a, b, least, 0.8, shift), substring.alike(b, a, least, 0.8, -shift)
        there, here = (there, here) if there and here else ([], [])
        assert (g["doc"], g["to_doc"]) == (doc, to_doc)
        assert [(s["begin"], s["end"]) for s in g["spans"]] == [(lo + x, lo + y + substring.SHINGLE) for x, y in there]
        assert [(s["begin"], s["end"]) for s in g["to_spans"]] == [(to_lo + x, to_lo + y + substring.SHINGLE) for x, y in here]
        key, at = (np.array([w[n] for w in windows], np.int64) for n in ("key", "at"))
        assert sorted((w["key"], w["at"]) for w in g["finer"]) == sorted(zip(*(x.tolist() for x in substring.parted(a, b, shift, there, key, at, lo)), strict=True))


def brute_passages(docs, least_words, similarity):
    """{id: (merged spans, class)}: every two stretches of all documents compared, along every diagonal that has a shingle in common."""
    least = least_words - substring.SHINGLE + 1
    shingles = {i: (substring.shingles_of(t.encode()) >> np.uint64(32)).astype(np.uint32) for i, t in docs.items()}
    spans, links = {i: set() for i in docs}, {i: set() for i in docs}
    for i in docs:
        for j in (j for j in docs if j > i):
            a, b = shingles[i], shingles[j]
            at = {v: q for q, v in enumerate(b.tolist())}
            for diagonal in {at[v] - p for p, v in enumerate(a.tolist()) if v in at}:
                there, here = substring.alike(a, b, least, similarity, diagonal), substring.alike(b, a, least, similarity, -diagonal)
                if there and here:
                    links[i].add(j)
                    links[j].add(i)
                    spans[i] |= {(x, y + substring.SHINGLE) for x, y in there}
                    spans[j] |= {(x, y + substring.SHINGLE) for x, y in here}
    out = {}
    for i in docs:
        merged = []
        for x, y in sorted(spans[i]):
            if merged and x <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], y)
            else:
                merged.append([x, y])
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in links[todo.pop()] if k not in seen and not seen.add(k)]
        out[i] = ([tuple(m) for m in merged], min(seen), links[i])
    return out


def copies_of_passages(seed):
    """Exact and edited passages, shared by two documents or many, two in one document, a common phrase that is too short."""
    random_ = random.Random(seed)
    fresh = lambda n: [f"u{random_.randrange(10**9)}" for _ in range(n)]
    common, passages = fresh(30), [fresh(random_.randrange(70, 130)) for _ in range(12)]
    docs = {}
    for i in range(90):
        words = fresh(random_.randrange(20, 90))
        for _ in range(random_.randrange(0, 3)):
            piece = list(random_.choice(passages))
            if i % 4 == 1:
                piece[random_.randrange(30, len(piece) - 30)] = "other"
            elif i % 4 == 2:
                piece.insert(random_.randrange(30, len(piece) - 30), "more")
            words += piece + fresh(random_.randrange(25, 60))
        if i % 5 == 0:
            words += common + fresh(30)
        docs[i] = " ".join(words)
    return docs


@pytest.mark.parametrize("functions", [4, 8])
def test_passages_and_classes_are_those_of_brute_force(spark, functions):
    """Eight functions give all of it. The default of four is a matter of chance at similarities near 0.8 (see the README):
    it must find 97 % of the words, all classes here, and nothing else."""
    docs = copies_of_passages(17)
    want = brute_passages(docs, 50, 0.8)
    found = substring.repeated(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4), functions=functions)
    got = {r.doc_id: r for r in found.collect()}
    spans = {i: [(s.begin, s.end) for s in r.spans] for i, r in got.items()}
    words = lambda found: {(i, w) for i, own in found.items() for x, y in own for w in range(x, y)}
    all_spans = {i: own for i, (own, _, _) in want.items()}
    assert {i: r.class_id for i, r in got.items()} == {i: c for i, (_, c, _) in want.items()}
    assert len({c for _, c, _ in want.values()}) > 10
    assert all(set(r.linked_to) <= want[i][2] for i, r in got.items())
    if functions == 8:
        assert spans == all_spans
    assert words(spans) <= words(all_spans) and len(words(spans)) >= 0.97 * len(words(all_spans))
