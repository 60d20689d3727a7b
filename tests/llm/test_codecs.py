import hashlib
import io
import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lodestone.llm import pieces, warc
from lodestone.llm.common import give_back
from tests_llm_shared import TEXTS


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.read_model(), 1.0)


@pytest.mark.parametrize("text", ["", "a  b", "  lead", " x\ty\nz ", "é ½ ① 日本 \U0001f600", "▁ literal ▁▁", "\x00\x01", "x" * 300, "theretherethere " * 30])
def test_round_trips(vocabulary, text):
    assert vocabulary.decoded(vocabulary.encoded(text)) == text
    for x in vocabulary.sampled(text, 4, np.random.default_rng(3))[0]:
        assert vocabulary.decoded(x["ids"]) == text


def all_paths(vocabulary, text):
    whole = {(): 1.0}
    for unit in vocabulary.split(text):
        found, stack = {}, [((), 1.0, 0)]
        while stack:
            path, w, at = stack.pop()
            if at == len(unit):
                found[path] = w
            else:
                stack += [(path + got, w * step, end) for end, got, step in vocabulary.edges(unit, at)]
        total = sum(found.values())
        whole = {a + b: x * y / total for a, x in whole.items() for b, y in found.items()}
    return whole


def test_units_learned_together_are_those_made_alone(vocabulary):
    other = pieces.Pieces(pieces.read_model(), 1.0)
    units = {u for t in TEXTS.values() if t for u in vocabulary.split(t[:2000])}
    other.learn(units)
    for u in units:
        a, b = other.units[u], vocabulary.unit(u)
        assert a.best == b.best and a.p_best == pytest.approx(b.p_best)


def test_the_best_path_and_its_probability(vocabulary):
    paths = all_paths(vocabulary, "the cat")
    assert tuple(vocabulary.encoded("the cat")) == max(paths, key=paths.get)
    unit = vocabulary.unit("▁the")
    assert unit.p_best == pytest.approx(max(all_paths(vocabulary, "the").values()))


def test_samples_follow_the_distribution_without_replacement(vocabulary):
    text, n = "the cat on", 6000
    p = all_paths(vocabulary, text)
    first, second, weighed = Counter(), Counter(), Counter()
    for s in range(n):
        (a, b), _ = vocabulary.sampled(text, 2, np.random.default_rng([5, s]))
        x, y = tuple(a["ids"]), tuple(b["ids"])
        assert x != y and a["value"] >= b["value"] and a["log_p"] == pytest.approx(math.log(p[x]))
        first[x] += 1
        second[y] += 1
        for z in (a, b):
            weighed[tuple(z["ids"])] += math.exp(z["log_p"]) / z["inclusion"]
    for path in sorted(p, key=p.get)[-4:]:
        other = sum(p[o] * p[path] / (1 - p[o]) for o in p if o != path)
        assert first[path] / n == pytest.approx(p[path], abs=0.03)
        assert second[path] / n == pytest.approx(other, abs=0.03)
        assert weighed[path] / n == pytest.approx(p[path], abs=0.04)  # inclusion scores make the estimate unbiased


def test_later_draws_from_a_unit_of_near_equal_paths():
    vocabulary, text, n = pieces.Pieces(pieces.read_model(), 0.78), "rea", 6000
    p = all_paths(vocabulary, text)
    assert len(p) >= 3 and sorted(p.values())[-3] > 0.28
    drawn = [Counter(), Counter(), Counter()]
    for s in range(n):
        for counter, x in zip(drawn, vocabulary.sampled(text, 3, np.random.default_rng([9, s]))[0], strict=True):
            counter[tuple(x["ids"])] += 1
    for path in p:
        second = sum(p[a] * p[path] / (1 - p[a]) for a in p if a != path)
        third = sum(p[a] * p[b] / (1 - p[a]) * p[path] / (1 - p[a] - p[b]) for a in p for b in p if len({a, b, path}) == 3)
        for counter, want in zip(drawn, (p[path], second, third), strict=True):
            assert counter[path] / n == pytest.approx(want, abs=0.02)


def test_short_texts_have_few_segmentations(vocabulary):
    found, threshold = vocabulary.sampled("ab", 50, np.random.default_rng(1))
    assert {tuple(x["ids"]) for x in found} == set(all_paths(vocabulary, "ab")) and threshold == -math.inf
    assert all(x["inclusion"] == 1.0 for x in found)


def test_samples_of_documents(spark, edge, empty):
    rows = pieces.samples(edge, k=3).collect()
    again = {(r.doc_id, r["sample"]): r["ids"] for r in pieces.samples(edge.repartition(7), k=3).collect()}
    assert all(r.round_trip and r.n_pieces == len(r["ids"]) and again[r.doc_id, r["sample"]] == r["ids"] for r in rows)
    by = Counter(r.doc_id for r in rows)
    assert by[1] == 3 and by[2] == 6 and by[4] == by[5] == 1 and by[9] == 3
    short = {(r.doc_id, r["sample"]): r["ids"] for r in pieces.samples(edge, k=3, digest=True).collect()}
    assert all(short[r.doc_id, r["sample"]] == pieces.ids_digest(np.array(r["ids"], np.int32)) for r in rows)
    assert pieces.samples(empty).count() == 0


def test_encode_and_decode_columns(spark, edge):
    coded = edge.select("text", pieces.encode(F.col("text"), spark).alias("ids"))
    back = coded.select("text", pieces.decode(F.col("ids"), spark).alias("back"))
    assert back.where("not (text <=> back)").count() == 0


PAGES = [(1, "http://a/", "x" * 1500), (2, "http://b/", "x" * 1500), (3, None, "y" * 10), (4, "http://c/\r\nX: y", "y" * 10), (5, "", None), (6, "u", ""), (7, "u", "é" * 600), (9, "u", "x" * 1500), (None, "u", "x" * 1500), (10, "u", "z\r\n\r\n" * 400)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, payload string").repartition(3)
    manifest = warc.write_archives(pages, str(tmp_path / "warc"), archive_bytes=4000)
    assert manifest.count() >= 3 and manifest.agg(F.sum("n_records")).first()[0] == len(PAGES)
    rows = {r.page_id: r for r in warc.read_archives(manifest, with_payload=True).collect()}
    for page_id, url, html in PAGES:
        r, payload = rows[page_id], (html or "").encode()
        revisit = html == "x" * 1500 and page_id != 9
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == payload
    assert rows[4].url == "http://c/%0D%0AX: y" and rows[3].url is None
    assert warc.read_archives(warc.write_archives(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_an_archive_is_a_dictionary_and_frames():
    records = [warc.record("response", i, f"http://h/{i}", f"<html>page {i} of the archive</html>".encode() * 5) for i in range(400)]
    data = b"".join(warc.archive(records))
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert list(warc.frames(io.BytesIO(data), chunk=100))[1:] == records
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(data) < plain
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-3])))


def test_damaged_payloads_are_noticed():
    data = warc.record("response", 1, "u", b"payload").replace(b"payload", b"paYload")
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(data)


def test_tables_begin_anew_in_the_memory_that_they_have():
    own = pieces.Pieces(pieces.read_model())
    text = "Привет, world " * 3
    before, held = own.sampled(text, 3, np.random.default_rng(1)), own.units.till
    own.units.clear()
    assert own.units.till is held and own.units.count == 0
    after = own.sampled(text, 3, np.random.default_rng(1))
    assert after == before
    own.units.drop()
    own.units.clear()
    assert own.sampled(text, 3, np.random.default_rng(1)) == before


def test_tables_of_units_keep_their_size(monkeypatch):
    monkeypatch.setattr(pieces, "EDGES", 6000)
    own, random = pieces.Pieces(pieces.read_model()), np.random.default_rng(3)
    for _ in range(12):  # units of some 14 letters, so of more than 12 edges each
        own.learn({"▁" + "".join(random.choice(list("etaoinshr"), 14)) for _ in range(20)})
        assert len(own.units.till) == 6000


def test_freed_memory_goes_back_to_the_system():
    held = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")) // 1024  # noqa: E731, SIM115
    blocks = [np.ones(8000) for _ in range(2000)]  # 128 MB in blocks too small to be mapped by themselves
    last, full = np.ones(8000), held()
    blocks.clear()
    give_back()
    assert full - held() > 100 and last[0] == 1
