import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import boosting, decontam, hmm, quality, toxicity, url_filter
from tests_llm_shared import TEXTS

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(docs, items, width):
    windows = {}
    for item, text in items.items():
        words = ALNUM.findall(low(text))
        size = min(width, len(words))
        for at in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[at : at + size]), set()).add(str(item))
    out = {}
    for i, text in docs.items():
        words, hit, found = ALNUM.findall(low(text)), set(), set()
        for window, of in windows.items():
            for at in range(len(words) - len(window) + 1):
                if tuple(words[at : at + len(window)]) == window:
                    hit.update(range(at, at + len(window)))
                    found |= of
        out[i] = (len(words), len(hit), sorted(found))
    return out


def test_decontamination_is_brute_force(spark):
    rng = random.Random(2)
    words = [rng.choice("abcd") * rng.randrange(1, 3) for _ in range(300)]
    items = {i: " ".join(words[i * 7 : i * 7 + rng.randrange(1, 25)]) for i in range(12)} | {50: None, 51: "", 52: "É 日本 x", 53: "a, A-a"}
    docs = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120))) for i in range(40)} | {99: " ".join(words), 98: None, 97: "zz é 日本 x! yy"}
    got = decontam.contamination(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4), spark.createDataFrame(list(items.items()), "item_id bigint, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == brute_hits(docs, items, 10)


def test_decontamination_of_odd_tables(spark, edge, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = decontam.contamination(edge, none).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.n_hit == 0 and r["items"] == [] for r in rows)
    assert decontam.contamination(empty, none).count() == 0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


@pytest.mark.parametrize("text", [*[t for i, t in TEXTS.items() if i not in (9, 10)], "a b c d e a b c d e", "a a a a a a", "# x\n# x\n\n# x", "<p>é\x0b|x"])
def test_counts(text):
    assert quality.counts_of(None if text is None else text.encode())[:5] == brute_counts(text)


def test_binomial_tail():
    for n, k, p in [(10, 0, 0.1), (50, 3, 0.05), (20, 20, 0.5), (400, 2, 0.01)]:
        want = sum(math.comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(min(k, n) + 1))
        assert quality.binomial_tail(n, k, p) == pytest.approx(min(1, want))


def test_cutoffs_need_evidence():
    grid = [50.0, 10.0, 5.0]
    assert quality.chosen_cutoff(grid, [20, 0, 0, 0], [0, 0, 10, 0], 0.01, 0.01) is None  # too few good documents
    assert quality.chosen_cutoff(grid, [2000, 0, 0, 0], [0, 0, 10, 0], 0.01, 0.01) == 10.0
    assert quality.chosen_cutoff(grid, [2000, 500, 0, 0], [0, 10, 0, 0], 0.01, 0.01) is None  # would reject good ones


def test_false_rejections_stay_limited():
    """Over many draws of labels the chosen cutoff rejects more than the risk in at most the level's share of them."""
    rng, grid, risk, level = np.random.default_rng(1), [90.0, 70.0, 50.0, 30.0, 10.0], 0.05, 0.05
    above = np.array([0.0, 0.01, 0.03, 0.06, 0.2])  # share of good documents above each cutoff
    wrong = 0
    for _ in range(300):
        u = rng.random(400)
        good = np.bincount((u[:, None] < above).sum(1), minlength=6).tolist()
        chosen = quality.chosen_cutoff(grid, good, [0, 0, 0, 0, 0, 1000], risk, level)
        wrong += chosen is not None and above[grid.index(chosen)] > risk
    assert wrong / 300 <= level + 0.03


def test_quality_of_documents(spark, edge, empty):
    good = [(i, f"clean words number {i} follow each other here without any trouble at all {i}") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"w{i}x{j}###" for j in range(20))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in good + bad], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id bigint, quality int")
    verdict = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert sum(verdict[i].kept for i, _ in good) >= 2990 and not any(verdict[i].kept for i, _ in bad)
    assert quality.keep_good(docs, labels).count() == sum(r.kept for r in verdict.values())
    rows = quality.judged(edge, labels.limit(0)).collect()
    assert len(rows) == edge.count() and {r.doc_id: r.kept for r in rows}[4] is False and {r.doc_id: r.kept for r in rows}[1] is True
    assert quality.keep_good(edge, labels).columns == edge.columns and quality.judged(empty, labels).count() == 0


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    p = 1 / (1 + np.exp(-(3 * (x[:, 0] * x[:, 1] > 0) - 1.5)))
    y = (rng.random(4000) < p).astype(int)
    trees = boosting.fitted(x[:2000], y[:2000])
    calibrated = boosting.Isotonic(trees.margin(x[2000:3000]), y[2000:3000])  # on other rows than the trees'
    got = calibrated(trees.margin(x[3000:]))
    assert np.abs(got - p[3000:]).mean() < 0.1 and ((got >= 0) & (got <= 1)).all()
    order = np.argsort(trees.margin(x[3000:]))
    assert (np.diff(got[order]) >= 0).all()


def test_toxicity_on_held_out_documents(spark, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    docs = []
    for i in range(3000):
        words = [word() for _ in range(rng.randrange(10, 60))]
        toxic = i % 7 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zzgrub", "zzgruben", "qqvile"]))
        docs.append((i, " ".join(words), int(toxic)))
    frame = spark.createDataFrame([d[:2] for d in docs] + [(None, None), (9001, "")], "doc_id bigint, text string").repartition(4)
    rows = toxicity.scored(frame, spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id bigint, toxic int")).collect()
    assert len(rows) == 3002 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    held = [(r.predicted, docs[r.doc_id][2]) for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 3000]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert toxicity.scored(empty, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0


def test_toxicity_without_labels(spark, edge):
    rows = toxicity.scored(edge, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert len(rows) == edge.count() and all(r.predicted == 0 for r in rows)


def brute_forward(model, text):
    paths = np.log(model.start * model.emit[text[0]])
    for s in text[1:]:
        paths = np.logaddexp.reduce(paths[:, None] + np.log(model.move), axis=0) + np.log(model.emit[s])
    return np.logaddexp.reduce(paths)


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(4)
    model = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3).T)
    texts = [rng.integers(0, 9, n) for n in (1, 5, 40, 3, 1)]
    assert hmm.forward(model, texts) == pytest.approx([brute_forward(model, t) for t in texts])


def test_expected_counts_raise_the_likelihood():
    rng = np.random.default_rng(4)
    texts = [np.repeat(rng.integers(0, 2, 6), 5) * 4 + rng.integers(0, 4, 30) for _ in range(60)]
    frequencies = np.bincount(np.concatenate(texts), minlength=9).astype(float)
    model, values = hmm.Model.initial(frequencies, 2, 1), []
    for _ in range(12):
        start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((9, 2))
        values.append(hmm.expected(model, texts, start, move, emit))
        assert start.sum() == pytest.approx(60) and emit.sum() == pytest.approx(1800) and move.sum() == pytest.approx(1740)
        model = hmm.Model.from_counts(start, move, emit, frequencies, prior=1e-6)
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:], strict=False)) and values[-1] > values[0] + 50


def test_scores_of_documents(spark, edge, empty):
    from collections import Counter

    got = hmm.scored(edge, rounds=2).collect()
    assert len(got) == edge.count()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    rows = [(i, t) for i, t in TEXTS.items()] + [(2, TEXTS[2]), (None, "no id at all in this row")]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    for r in got:
        own = tokens(TEXTS.get(r.doc_id, "no id at all in this row"))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(own), total)
        assert r.n_known == sum(counts[t] > 0 for t in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own))
        assert r.score < 0 and math.isfinite(r.score)
    assert hmm.scored(empty).count() == 0


URLS = ["http://News.Example.ORG/es/1?x#y", "https://example.org/en/15", "http://a.b.com/fr/2", "http://b.com/de/", "http://x.com", "nothing", None, "", "http://cheap-pills.example.net/en/1", "https://library.example.net/en/1", "ftp://H:80/p#f?q", "http://org", "http://notorg.net/", "a://b://c/d", "http://\n/x\ny"]


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return low(m[1]), m[2]


def brute_rule(host, path):
    fits = []
    for action, rule in url_filter.RULES:
        at, _, rest = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_scores(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://z.org/")], "page_id bigint, url string")
    weights, bias = url_filter.trained_weights(url_filter.labelled_urls(spark))
    rows = url_filter.judged(pages, url_filter.labelled_urls(spark)).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = brute_parts("http://z.org/" if r.page_id is None else URLS[r.page_id])
        rule, action = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (action or ("block" if r.score >= 0.55 else "allow"))
    by = {r.page_id: r for r in rows}
    assert by[8].verdict == "block" and by[9].verdict == "allow"
    assert url_filter.judged(pages.limit(0), url_filter.labelled_urls(spark)).count() == 0
    plan = url_filter.judged(pages, url_filter.labelled_urls(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_url_training_is_gradient_descent(spark):
    """The dual expression gives the weights of plain gradient descent on the n-gram counts."""
    labelled = spark.createDataFrame([("http://aa.b/c", 1), ("http://dd.e/f", 0), ("http://aa.e/f", 1), ("x", None)], "url string, blocked int")
    weights, bias = url_filter.trained_weights(labelled)
    grams = url_filter.gram_buckets(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    rows = labelled.where("blocked is not null").select("blocked", grams.alias("g")).collect()
    x = np.zeros((len(rows), url_filter.BUCKETS))
    for v, r in zip(x, rows, strict=True):
        np.add.at(v, r.g, 1 / math.sqrt(len(r.g)))
    y, w, b = np.array([r.blocked for r in rows]), np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(url_filter.STEPS):
        slope = 1 / (1 + np.exp(-(x @ w + b))) - y
        w = w * (1 - url_filter.RATE * url_filter.DECAY) - url_filter.RATE * x.T @ slope
        b = b * (1 - url_filter.RATE * url_filter.DECAY) - url_filter.RATE * slope.sum()
    assert np.allclose(weights, w) and bias == pytest.approx(b)


def test_equal_margins_are_one_pool():
    margin, y = np.repeat([0.0, 1.0], 10), np.array([0] * 8 + [1] * 2 + [0] * 2 + [1] * 8)
    for order in (np.arange(20), np.arange(20)[::-1], np.lexsort((y, margin))):
        assert boosting.Isotonic(margin[order], y[order])(np.array([0.0, 1.0])) == pytest.approx([2.5 / 11, 8.5 / 11])


def brute_cutoffs(docs, risk=0.05, delta=0.05):
    """{(stratum, rule): cutoff} by trying all cutoffs on every document anew. docs: (stratum, good, testing, {rule: rate})."""
    tests = {s: sum(g and t for x, g, t, _ in docs if x == s) for s in {x for x, *_ in docs}}
    strata = sorted(tests)
    while any(0.95 ** tests[s] > delta / len(strata) for s in strata):
        strata = [s for s in strata if 0.95 ** tests[s] <= delta / len(strata)]
    out = {}
    for s in strata:
        grow, test = ([(g, r) for x, g, t, r in docs if x == s and t == which] for which in (False, True))
        n_good, n_bad = max(1, sum(g for g, _ in grow)), max(1, sum(not g for g, _ in grow))
        rejects = lambda config, rates: any(rates[rule] > c for rule, c in config.items())
        value = lambda config, rows, good, bad: sum((-quality.COST / good if g else 1 / bad) for g, r in rows if rejects(config, r))
        config, path = {}, []
        while True:
            now = value(config, grow, n_good, n_bad)
            tries = [(rule, c) for rule, (_, _, grid) in quality.RULES.items() for c in grid if c < config.get(rule, 1e9)]
            gains = [value(config | {rule: c}, grow, n_good, n_bad) - now for rule, c in tries]
            if not gains or max(gains) <= 1e-9:
                break
            rule, c = tries[next(i for i, g in enumerate(gains) if g > max(gains) - 1e-9)]
            config = config | {rule: c}
            path.append(config)
        good, bad = sum(g for g, _ in test), max(1, sum(not g for g, _ in test))
        best, choice = 1e-9, {}
        for config in path:
            false = sum(g and rejects(config, r) for g, r in test)
            if sum(math.comb(good, k) * risk**k * (1 - risk) ** (good - k) for k in range(false + 1)) > delta / len(strata):
                break
            if (v := value(config, test, good, bad)) > best + 1e-9:
                best, choice = v, config
        out |= {(s, rule): c for rule, c in choice.items()}
    return out


def test_cutoffs_and_verdicts_are_those_of_brute_force(spark):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(1500):
        good = rng.random() < 0.7
        words = [f"w{i}x{j}" + ("#" * rng.integers(0, 4) if rng.random() < (0.02 if good else 0.5) else "") for j in range(rng.integers(12, 30))]
        words = [w.upper() if rng.random() < (0.05 if good else 0.3) else w for w in words]
        docs.append((i, " ".join(words) + ("\n" + words[0] + "\n" + words[0]) * int(rng.integers(0, 2 if good else 4)), ["en", "de", "fr"][i % 3] if i % 50 else "xx"))
        labels.append((i, int(good)))
    frame, marks = spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    testing = {r.doc_id: r.t for r in frame.select("doc_id", (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)) == 1).alias("t")).collect()}
    rows, rates = [], {}
    for i, text, lang in docs:
        c = dict(zip(quality.COUNTS, quality.counts_of(text.encode()), strict=True))
        rates[i] = {rule: eval(over, {}, c) / c[under] if c[under] else 0.0 for rule, (over, under, _) in quality.RULES.items()}  # noqa: S307
        if c["n_words"] >= 10 and 100 * c["n_repeat_words"] <= 20 * c["n_words"]:
            rows.append((lang, bool(labels[i][1]), testing[i], rates[i]))
    want = brute_cutoffs(rows)
    assert {s for s, _ in want} == {"en", "de", "fr"}  # "xx" has too few labels
    got = {(r.stratum, r.rule): r.cutoff for r in quality.thresholds(quality.measured(frame, "doc_id", "text", "lang"), marks).collect()}
    assert got == want
    verdict = {r.doc_id: r for r in quality.judged(frame, marks).collect()}
    for i, _, lang in docs:
        assert verdict[i].kept == (not verdict[i].base_failed and not any(rates[i][rule] > c for (s, rule), c in want.items() if s == lang))
