"""Fingerprints, ranked search and hard negatives against brute force."""

import re
from collections import defaultdict
from math import log

import compare
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import lexical, mining, simhash
from gridloom.llm.queries import ORACLE_SQL, QUERIES


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints, distance=4):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {p: find(p) for p in order}


def brute_simhash(rows):
    prints = [brute_print(t) for _, t in rows]
    root = brute_roots(prints)
    ids = defaultdict(list)
    for (d, _), p in zip(rows, prints, strict=True):
        ids[root[p]].append(d)
    return sorted(((d, f"{p:016x}", min((x for x in ids[root[p]] if x is not None), default=None)) for (d, _), p in zip(rows, prints, strict=True)), key=str)


def test_simhash(docs, odd, monkeypatch):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = simhash.simhash_components(df)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_simhash(rows)


def test_fingerprints_in_slices(monkeypatch):
    texts = pa.array([" ".join(f"w{i % 7}" for i in range(n)) for n in (0, 3, 50, 4, 200)])
    monkeypatch.setattr(simhash, "SLICE", 37)
    assert simhash.fingerprints(texts.cast(pa.binary())).tolist() == [brute_print(t.as_py()) for t in texts]


def test_anchors_are_all_within_reach():
    """For each half the code words within 2 of it, and none else; and any two halves within 2 share one."""
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 300).astype(np.uint64)
    at, key = simhash.anchors(fp)
    of = defaultdict(set)
    for a, k in zip(at.tolist(), key.tolist(), strict=True):
        half, word = k >> 32, k & 0xFFFFFFFF
        place = 0
        for bit in range(31):
            place ^= (bit + 1) * (word >> bit & 1)
        assert place == 0 and ((int(fp[a]) >> 32 * half & 0xFFFFFFFF) ^ word).bit_count() <= 2
        of[a, half].add(word)
    assert {len(x) for x in of.values()} <= {2, 17}
    for _ in range(2000):
        x = int(fp[rng.integers(300)])
        y = x
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y ^= 1 << int(b)
        both = [set(zip(*(v.tolist() for v in simhash.anchors(np.array([z], np.uint64))[1:]))) for z in (x, y)]
        assert both[0] & both[1]


@pytest.mark.parametrize("part", [2048, 16])
def test_links_of_clusters(spark, monkeypatch, part):
    """Balls of near fingerprints, chains and strangers; with parts of 16 each anchor's group is dealt into several."""
    from gridloom.llm.common import components

    rng = np.random.default_rng(8)
    prints = set(rng.integers(0, 1 << 62, 200).tolist())
    for size, flips in ((150, 3), (60, 6), (40, 9)):
        centre = int(rng.integers(0, 1 << 62))
        for _ in range(size):
            x = centre
            for b in rng.choice(63, rng.integers(0, flips + 1), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    x = int(rng.integers(0, 1 << 62))
    for i in range(15):  # each links only with the next
        prints.add(x)
        x ^= 0b1111 << (4 * i)
    monkeypatch.setattr(simhash, "PART", part)
    df = spark.createDataFrame([(p,) for p in sorted(prints)], "fp long")
    links = simhash.near_links(df)
    got = {r.node: r.root for r in components(links.distinct()).collect()}
    want = brute_roots(prints)
    groups = lambda roots: {frozenset(p for p in roots if roots[p] == r) for r in roots.values()}
    assert groups({p: got.get(p, p) for p in prints}) == groups(want)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() > 0 or part == 2048  # forests, not pairs


def test_no_fingerprints(none):
    assert simhash.simhash_components(none).count() == 0


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=20):
    docs = [(d, TERMS.findall(lower(t))) for d, t in docs]
    own = [(d, t) for d, t in docs if t]
    n_docs, n_terms = len(own), sum(len(t) for _, t in own)
    df = defaultdict(int)
    for _, t in own:
        for x in set(t):
            df[x] += 1
    out = []
    for item, text in set(items):
        scored = []
        for d, t in own:
            m, score = 75 + 25 * len(t) * n_docs // n_terms, 0
            for x in TERMS.findall(lower(text)):
                if tf := t.count(x):
                    score += int(1000 * log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "Alpha gamma, p3 p4 p3"), (1, "Alpha gamma, p3 p4 p3"), (2, None), (3, "  ..."), (None, "two words é"), (5, "nothing-of-this"), (1, "w1x1 中文"), (6, "alpha")]


@pytest.mark.parametrize(("shard", "window", "items"), [(8 << 20, 4096, 256), (1, 2, 1)])
def test_search(spark, odd, monkeypatch, shard, window, items):
    for name, value in (("SHARD_BYTES", shard), ("WINDOW", window), ("ITEMS", items)):
        monkeypatch.setattr(lexical, name, value)
    rows = odd.repartition(3)
    asked = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("shard", F.lit("clash"))
    got = lexical.search(lexical.build_index(rows), asked, k=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_search([(r.doc_id, r.text) for r in odd.collect()], ITEMS, 4)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_nothing(spark, odd, none):
    asked = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.build_index(none), asked).count() == 0
    assert lexical.search(lexical.build_index(odd), asked.limit(0)).count() == 0


def test_varints():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 40, (1 << 62) + 5])
    data, at = lexical.varints(values)
    assert lexical.from_varints(data.tobytes()).tolist() == values.tolist() and len(at) == 10 and lexical.from_varints(b"").tolist() == []


def test_terms_that_share_a_hash(monkeypatch):
    texts = pa.array([b"aa bb aa", b"bb cc"])
    plain = lexical.shard_rows(pa.array([1, 2]), texts, 0).to_pylist()
    words = lexical.tk.words

    def same(*args, **kwargs):
        w = words(*args, **kwargs)
        w.hash[:] = 7
        return w

    monkeypatch.setattr(lexical.tk, "words", same)
    key = lambda rows: sorted(map(str, rows))
    assert key(lexical.shard_rows(pa.array([1, 2]), texts, 0).to_pylist()) == key(plain)


def brute_negatives(rows, k, positives, every=100):
    out, rows = [], [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}]
    for a, lab, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, m == lab) for i, m, w in rows if i != a)  # noqa: B905
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            fit = [(n, j) for n, j, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:k]
            out += [(a, i, r + 1, j, -s, -n) for r, (n, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("group", "anchors", "slack"), [(8192, 1024, 4), (40, 2, 0)])
def test_negatives(spark, monkeypatch, group, anchors, slack):
    """Ties of many equal vectors (negatives and positives), repeated rows, nulls, odd lengths; small blocks; no early end."""
    rng = np.random.default_rng(4)
    for name, value in (("GROUP", group), ("ANCHORS", anchors), ("SLACK", slack)):
        monkeypatch.setattr(mining, name, value)
    base = rng.normal(size=6)
    rows = [(i, int(rng.integers(3)), (base + rng.normal(size=6) * rng.choice([0.2, 1.0])).tolist()) for i in range(300)]
    rows += [(1000 + i, i % 3, (base * 0.7).tolist()) for i in range(200)]  # as many equal scores
    rows += [(i, 1, [1.0, 2.0]) for i in (700, 2000)] + [rows[0], rows[5], (None, 1, [1.0]), (4000, None, [1.0]), (4100, 1, None), (4200, 1, [1.0, None]), (4300, 2, [float("nan")] * 6), (4400, 2, [float("inf")] * 6), (4500, 2, []), (5000, 9, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"h": F.lit(1), "score": F.lit(2), "id": F.lit(3)})
    got = sorted(map(tuple, mining.mine_negatives(df, k=4, positives=3).collect()))
    assert got == brute_negatives(rows, 4, 3) and len(got) > 20
    assert mining.mine_negatives(df.limit(0)).count() == 0
    assert mining.mine_negatives(df.where("vec_id = 7")).count() == 0


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_hard_negatives"])
def test_queries_with_sql(spark, sf, name):
    assert not compare.differences(QUERIES[name](spark, sf), compare.connect(sf), ORACLE_SQL[name])
