"""Statistics against brute force, and models by their accuracy on rows they never saw."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm.common import cut
from gridloom.llm.labels import fit_logistic
from gridloom.llm.quality_classifier import estimate_prior, fit_pu, quality, risk_sums
from gridloom.llm.quality_rules import STATS, fit_forest, judge, pick_threshold, rule_stats, text_stats
from gridloom.llm.toxicity import CUTOFF, SHARE, TELLING, count_pairs, discounts, models, toxicity

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + i for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for i in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_statistics(docs, odd):
    for df in (docs, odd):
        want = sorted(((r.doc_id, *brute_stats(r.text)) for r in df.collect()), key=str)
        assert sorted((tuple(r) for r in rule_stats(df).collect()), key=str) == want


def test_statistics_of_lines():
    texts = ["a\na\n\n\na b\nb\n", "", "\n", "x y z x y z", "a b é\né\né"]
    got = text_stats(pa.array([t.encode() for t in texts]))
    assert [tuple(int(got[n][i]) for n in STATS) for i in range(len(texts))] == [brute_stats(t) for t in texts]


def test_forest_finds_what_stands_apart():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 0.1, (500, 3))
    f = fit_forest(x)
    assert f.score(np.array([[0.9, 0.05, 0.05]]))[0] > f.score(x).max()
    assert np.isfinite(fit_forest(np.zeros((0, 3))).score(np.zeros((2, 3)))).all()
    assert pick_threshold([]) == float("inf")


def test_rules_on_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    got = judge(cut(rule_stats(docs), "stats"), labels).join(labels, "doc_id").toPandas()
    ok = got[~got.base_failed]
    assert (ok.kept == (ok.quality == 1)).mean() > 0.97


def test_rules_edges(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert judge(cut(rule_stats(odd), "stats"), labels).count() == odd.count()
    assert judge(cut(rule_stats(odd), "stats"), labels.limit(0)).where("kept = base_failed").count() == 0
    assert judge(cut(rule_stats(none), "stats"), labels).count() == 0


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("model", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.9)])
def test_held_out(spark, model, label, least):
    docs, labels = (spark.read.parquet(f"{LARGER}/{n}.parquet") for n in ("documents", "labels"))
    got = model(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.score.to_numpy(), got[label].to_numpy()) > least


@pytest.mark.parametrize("model", [toxicity, quality])
def test_model_edges(spark, odd, none, model):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 1, 1), (6, 0, 0), (8, 1, 0), (None, 1, 1), (99, 0, 1), (12, None, None)], "doc_id long, quality int, toxic int")
    got = model(odd, labels)
    assert got.count() == odd.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert got.where(F.col("predicted") != (F.col("score") >= (0.5 if model is toxicity else 0.3)).cast("int")).count() == 0
    assert model(odd, labels.limit(0)).select("score").distinct().count() == 1
    assert model(none, labels).count() == 0


def test_labels_of_fold_zero_are_not_read(spark, odd):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({(r.doc_id, r.n_words): r.score for r in toxicity(odd, x).collect()} for x in (labels, other))
    assert a == b


def test_pu_fit():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 0.5, (3000, 2)), rng.normal(-1, 0.5, (3000, 2))
    u = np.vstack([good[2000:2700], bad[:300]])
    x, positive = np.hstack([np.vstack([good[:1000], u]), np.ones((2000, 1))]), np.arange(2000) < 1000
    sums = lambda w: risk_sums(x, positive, w)
    w = fit_pu(sums, 3, 0.5, unbiased=False)
    bins = lambda y: np.histogram(1 / (1 + np.exp(-y @ w[:-1] - w[-1])), 1000, (0, 1))[0]
    prior = estimate_prior(bins(good[1000:2000]), bins(u))
    assert 0.6 < prior < 0.8
    w = fit_pu(sums, 3, prior)
    assert (good[2700:] @ w[:-1] + w[-1] > 0).mean() > 0.95 and (bad[300:] @ w[:-1] + w[-1] < 0).mean() > 0.95
    assert fit_logistic(np.zeros((0, 1)), np.zeros(0)).tolist() == [0, 0]


def test_risk_sums():
    """Gradients and second derivatives against differences of the losses."""
    rng = np.random.default_rng(2)
    x, positive, w = np.hstack([rng.normal(size=(50, 2)), np.ones((50, 1))]), rng.random(50) < 0.4, rng.normal(size=3)
    losses = lambda w, part: np.split(risk_sums(x, positive, w), 2)[part][1:3]
    for part in (0, 1):
        own = np.split(risk_sums(x, positive, w), 2)[part]
        total, good, second = own[3:6], own[6:9], own[9:].reshape(3, 3)
        for i, e in enumerate(np.eye(3) * 1e-5):
            up, down = losses(w + e, part), losses(w - e, part)
            assert np.allclose((up - down) / 2e-5, [good[i], good[i] + total[i]], atol=1e-4)
            assert np.allclose((np.split(risk_sums(x, positive, w + e), 2)[part][6:9] - good) / 1e-5, second[i], atol=1e-3)


def brute_kneser_ney(rows):
    """(word given context) -> log P_1 - log P_0, by dictionaries."""
    pairs, start = [Counter(), Counter()], "<start>"
    for text, label in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        pairs[label].update(zip([start, *w], w, strict=False))
    both = pairs[0] + pairs[1]
    types = [Counter(w for _, w in c) for c in (*pairs, both)]
    off = lambda counts: (lambda d: lambda n: n - [0, *d][min(n, 3)] if n else 0)(discounts(np.bincount(np.minimum(list(counts.values()), 5), minlength=6)[1:]))
    size = len(types[2]) + 1

    def level(c, w, shared):
        f, total = off(types[c]), sum(types[c].values())
        return (f(types[c][w]) + (total - sum(map(f, types[c].values()))) * shared) / total if total else shared

    less = [off(c) for c in pairs]
    kept = [k for k in both if max(pairs[0][k], pairs[1][k]) >= CUTOFF]

    def back(c, w):
        shared = level(2, w, 1 / size)
        return (1 - SHARE) * level(c, w, shared) + SHARE * shared

    def p(c, u, w):
        n = sum(v for (a, _), v in pairs[c].items() if a == u)
        if not n or not any(a == u for a, _ in kept):
            return back(c, w)
        mass = {b: max(less[c](pairs[c][a, b]), 0) / n for a, b in kept if a == u}
        return mass.get(w, 0) + (1 - sum(mass.values())) * back(c, w)

    def texts(text):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        gaps = [np.log(back(1, x) / back(0, x)) for x in w]
        return [np.log(p(1, u, x) / p(0, u, x)) for u, x in zip([start, *w], w, strict=False)], [max(0, g - limit) for g in gaps]

    limit = TELLING * max(np.log(back(1, w) / back(0, w)) for w in [*types[2], ""])
    return texts


@pytest.mark.parametrize("most", [1 << 30, 700])
def test_kneser_ney(spark, most):
    """Evidence against dictionaries; a small bound deals the model in parts."""
    rng = np.random.default_rng(4)
    words = [f"W{i}" for i in range(25)]
    rows = [(" ".join(words[min(24, int(x))] for x in rng.exponential(4 + 3 * label, rng.integers(0, 30))), label) for label in (0, 1, 0) for _ in range(25)]
    df = spark.createDataFrame([(t.encode(), y) for t, y in rows], "text binary, label int")
    got = list(models(count_pairs(df), most))
    assert (len(got) > 1) == (most < 1 << 30)
    brute, new = brute_kneser_ney(rows), [*(t for t, _ in rows[::7]), "w1 other w2 w2 w3", ""]
    n, *sums = zip(*(m.evidence(pa.array([t.encode() for t in new])) for m in got), strict=True)
    for i, t in enumerate(new):
        want = brute(t)
        assert n[0][i] == len(want[0])
        assert np.allclose([sum(s[i] for s in each) for each in sums], [*map(sum, want)], atol=1e-4)


def test_toxicity_in_parts(spark, odd, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    whole, parts = ({(r.doc_id, r.k): r.score for r in toxicity(docs, labels, model_bytes=most).collect()} for most in (1 << 30, 30_000))
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-4 for k in whole)
    known = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (6, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity(odd, known, model_bytes=100).count() == odd.count()


def test_a_part_of_a_toxicity_model_is_bounded(spark):
    """No part has all contexts, and parts together, in one reading of the texts, give what they give one by one."""
    import pickle

    from gridloom.llm.toxicity import evidence

    rng = np.random.default_rng(5)
    texts = [" ".join(f"u{a} v{b}" for a, b in zip(rng.permutation(1500)[:300], rng.integers(0, 40, 300), strict=True)).encode() for _ in range(60)]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(3 * texts)], "text binary, label int")
    got = list(models(count_pairs(df), 10_000))
    assert len(got) > 5 and max(len(pickle.dumps(m)) for m in got) < 3 * 10_000
    new = pa.array([*texts[:5], b"", b"u1 other u2"])
    each, (n, *sums) = [m.evidence(new) for m in got], evidence(got, new)
    assert n.tolist() == each[0][0].tolist()
    assert np.allclose(sums, [np.sum([e[i] for e in each], 0) for i in (1, 2)])


def test_a_model_is_sent_without_its_tables(spark, docs, sf):
    """The driver makes and sends rows of hashes and values; the hash tables are made where they are used."""
    import pickle

    from gridloom.llm.toxicity import Lookup

    rng = np.random.default_rng(3)
    key = rng.integers(1, 1 << 63, 100_000).astype(np.uint64)
    table = Lookup(key, np.arange(200_000).reshape(-1, 2), [-1, -2])
    sent = pickle.dumps(table)
    assert len(sent) < 1.1 * (key.nbytes + 8 * len(key))
    there = pickle.loads(sent)
    assert (there.values[there.rows(key), 1] == 1 + 2 * np.arange(100_000)).all()
    assert (there.values[there.rows(np.array([7], np.uint64))] == [-1, -2]).all()


def test_a_lookup_takes_little_memory():
    """Hashes aren't kept twice, and the table is put together in parts."""
    import tracemalloc

    from gridloom.llm.toxicity import Lookup

    key = np.random.default_rng(4).integers(1, 1 << 63, 1_500_000).astype(np.uint64) * np.uint64(2)
    key = np.unique(key)
    table = Lookup(key, np.zeros((len(key), 2)), [1, 1])
    tracemalloc.start()
    found = table.rows(key[:1000])
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (found == np.arange(1000)).all()
    assert held < 18 * len(key) and peak < 40 * len(key)
    assert (np.concatenate([table.rows(key[a : a + 100_000]) for a in range(0, len(key), 100_000)]) == np.arange(len(key))).all()
    assert (table.rows(key[:1000] + np.uint64(1)) == -1).all()
