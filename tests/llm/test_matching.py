"""Joins on shingles, passages, benchmark windows and chats against brute force."""

import hashlib
import re
from collections import defaultdict

import compare
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gridloom.llm import chat, passages as ps
from gridloom.llm.decontaminate import contamination
from gridloom.llm.ngram_join import ngram_components


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def shingle_set(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return sorted(((d, len(s), min((x for x in ids[find(i)] if x is not None), default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components(docs, odd, n, percent):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df, n, percent).collect()]
        assert sorted(got, key=str) == brute_components(rows, n, percent)


def test_components_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for p in rng.choice(120, rng.integers(0, 5), replace=False):
            w[p] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df, 4, 85).collect()), key=str)
    assert got == brute_components(rows, 4, 85)


def test_no_rows(none):
    assert ngram_components(none).count() == 0
    assert ps.repeated_passages(none).count() == 0
    assert ps.without_passages(none, ps.repeated_passages(none)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), min_size=1, max_size=5), st.integers(2, 7))
def test_compact_windows_cover_each_subsequence_once(texts, t):
    values = [np.array([hash((x, 1)) * 2654435761 % (1 << 64) for x in text], np.uint64) for text in texts]
    first = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    own, l, c, r = ps.compact_windows(np.concatenate(values) if len(values) else np.zeros(0, np.uint64), first, t)
    for k, v in enumerate(values):
        high = (v >> np.uint64(32)).tolist()
        for i in range(len(v)):
            for j in range(i + t - 1, len(v)):
                place = min(range(i, j + 1), key=lambda x: (high[x], x))
                hold = [(a, b) for o, a, b, e in zip(own, l, c, r, strict=True) if o == k and a <= i <= b <= j <= e]
                assert hold == [(hold[0][0], place)]


def test_passages_against_brute_force(docs):
    rows = sorted(((r.doc_id, words(r.text)) for r in docs.collect()))
    text, seen, need = dict(rows), {}, defaultdict(set)
    for d, w in rows:
        own = []
        for i in range(len(w) - 50):
            key = tuple(w[i : i + 51])
            if key in seen:
                need[d] |= set(range(i, i + 51))
            else:
                own.append(key)
        seen |= dict.fromkeys(own, d)
    got = defaultdict(set)
    for r in ps.repeated_passages(docs).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
        a, b = shingle_set(" ".join(text[r.source_id][r.source_start : r.source_end]), 5), shingle_set(" ".join(text[r.doc_id][r.start : r.end]), 5)
        assert len(a & b) >= 0.8 * len(a | b) and r.source_id < r.doc_id and r.end - r.start >= 50
    assert need and all(need[d] <= got[d] for d in need)


def test_passages_edges(odd):
    found = ps.repeated_passages(odd)
    got = sorted((r.doc_id, r.source_id) for r in found.select("doc_id", "source_id").distinct().collect())
    assert got == [(7, 6), (9, 8)]
    left = {(r.doc_id, r.n): r for r in ps.without_passages(odd, found, count_col="n_cut").collect()}
    assert left[9, "clash"].text.startswith("other start of nine") and "p30" not in left[9, "clash"].text and left[9, "clash"].text.endswith("closing")
    assert "p30" in left[8, "clash"].text and left[4, "clash"].text is None and left[7, "clash"].text == "tail"
    assert len(ps.without_passages(odd, found).collect()) == odd.count()


def windows_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_contamination(rows, items):
    spans = defaultdict(set)
    for i, t in items:
        w = windows_of(t)
        for k in range(len(w) - 7 if len(w) >= 8 else min(1, len(w))):
            spans[tuple(w[k : k + 8])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w, hit, found = windows_of(t), set(), set()
        for n in {len(s) for s in spans}:
            for k in range(len(w) - n + 1):
                if (got := spans.get(tuple(w[k : k + n]))) is not None:
                    found |= got
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_contamination(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert rows_of(contamination(docs, items)) == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_contamination_edges(spark, odd, none):
    items = [(1, "beta gamma delta epsilon zeta eta theta iota"), (2, "ALPHA beta"), (3, "one"), (4, None), (5, "..."), (6, " ".join(f"p{i}" for i in range(10, 25))), (6, "one two"), (7, "É"), (8, "alpha beta")]
    df = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(contamination(odd, df)) == brute_contamination([(r.doc_id, r.text) for r in odd.collect()], items)
    assert contamination(none, df).count() == 0
    assert contamination(odd, df.limit(0)).where("n_items > 0").count() == 0


def test_chats(spark, sf):
    df = chat.format_chats(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert not compare.differences(df, compare.connect(sf), chat.SQL)


def test_chats_edges(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "user", None), (5, 0, "user", ""), (5, 1, None, "x"), (None, 0, "user", "solo"), (6, 0, "bot", "hi"), (7, 0, "user", "hi"), (7, 0, "user", "hi")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS conv", "3 AS h1")
    got = {r.conv_id: (r.n_turns, r.chat) for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, 5, None, 6, 7} and got[2][1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n" and got[7][0] == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_passages_of_frequent_lines(spark):
    """Every line is in many texts, so a key's first text and the one before are seldom those that a row repeats."""
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{i}_{k}" for k in range(8)) for i in range(40)]
    rows = [(i, " ".join(lines[k] for k in rng.permutation(40)[:8])) for i in range(600)]
    for i in range(0, 600, 10):
        w = rows[i][1].split()
        w[rng.integers(12, 52)] = "changed"
        rows.append((1000 + i, " ".join(w)))
    got = {(r.source_id, r.doc_id) for r in ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 1000 + i) for i in range(0, 600, 10)}


def _h(words):
    from gridloom.llm import textkernel as tk
    import pyarrow as pa

    return (tk.shingles(tk.words(pa.array([" ".join(words).encode()]), lower=True), 5)[0] >> np.uint64(32)).astype("<u4")


@pytest.mark.parametrize(("n", "place", "cut", "new"), [(96, 48, 0, 9), (104, 48, 7, 7)])
def test_passages_with_a_clause_inserted_or_replaced(n, place, cut, new):
    base = [f"t{i}" for i in range(n)]
    changed = [*base[:place], *(f"x{i}" for i in range(new)), *base[place + cut :]]
    for x, y in ((base, changed), (changed, base)):
        got = ps.common_passages(_h(x), _h(y))
        assert [(p.start, p.end, p.from_start, p.from_end) for p in got] == [(0, len(y), 0, len(x))]


@pytest.mark.parametrize(("words_each", "edits", "copies"), [(60, 1, 30), (100, 1, 30), (200, 2, 30)])
def test_recall_of_near_copies_in_clusters(spark, words_each, edits, copies):
    """Clusters of copies with an edited word or more each, within texts of their own: documents with an earlier holder."""
    rng = np.random.default_rng(words_each)
    rows, inner = [], []
    for k in range(6):
        base = [f"c{k}_{i}" for i in range(words_each)]
        for _ in range(copies):
            w = list(base)
            for p in rng.choice(words_each, edits, replace=False):
                w[p] = f"e{rng.integers(1 << 40)}"
            inner.append(" ".join(w))
    order = rng.permutation(len(inner))
    for d, i in enumerate(order):
        own = [f"o{rng.integers(1 << 40)}" for _ in range(80)]
        rows.append((d, " ".join([*own[:40], inner[i], *own[40:]])))
    sets = [shingle_set(inner[i], 5) for i in order]
    want = {d for d in range(len(rows)) if any(100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in range(d))}
    got = {r.doc_id for r in ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 60 and len(want & got) >= 0.95 * len(want)


@pytest.mark.parametrize("changed", [1, 2])
def test_passages_changed_at_the_same_place(spark, changed):
    """Two texts of frequent lines, each with words of its own at the same place; no text has the passage unchanged."""
    rng = np.random.default_rng(changed)
    lines = [" ".join(f"w{i}_{k}" for k in range(8)) for i in range(40)]
    some = lambda: " ".join(lines[k] for k in rng.permutation(40)[:8])
    rows = [(i, some()) for i in range(600)]
    for i in range(0, 600, 10):
        base, at = some().split(), int(rng.integers(24, 38))
        for j in range(2):
            rows.append((1000 + i + j, " ".join([*base[:at], *(f"x{i}_{j}_{k}" for k in range(changed)), *base[at + changed :]])))
    got = {(r.source_id, r.doc_id) for r in ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got >= {(1000 + i, 1001 + i) for i in range(0, 600, 10)}


def test_passages_of_two_texts_that_are_not_alike(spark):
    """The third text has a passage of the first and of the second, which differ too much from each other."""
    rows = []
    for k in range(40):
        for j, at in enumerate((15, 45, None)):
            w = [f"e{k}_{j}" if i == at else f"c{k}_{i}" for i in range(60)]
            rows.append((3 * k + j, " ".join([*(f"o{k}_{j}_{i}" for i in range(30)), *w, *(f"p{k}_{j}_{i}" for i in range(30))])))
    got = {(r.source_id, r.doc_id) for r in ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3 * k + j, 3 * k + 2) for k in range(40) for j in range(2)}


def test_passages_of_a_cluster_are_not_all_pairs(spark):
    """Copies with many edits: every word that an earlier text shares is listed and every class, but not every two texts."""
    rng = np.random.default_rng(11)
    base, rows = [f"b{i}" for i in range(400)], []
    for d in range(80):
        w = [x if rng.random() > 0.04 else f"e{rng.integers(40)}" for x in base]
        rows.append((d, " ".join(w)))
    need, pairs = defaultdict(set), set()
    for b in range(80):
        for a in range(b):
            for p in ps.common_passages(_h(rows[a][1].split()), _h(rows[b][1].split())):
                need[b] |= set(range(p.start, p.end))
                pairs.add((a, b))
    out = ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), classes=True).collect()
    got, held = {(r.source_id, r.doc_id) for r in out}, defaultdict(set)
    for r in out:
        held[r.doc_id] |= set(range(r.start, r.end))
    assert {r.class_id for r in out} == {0} and {r.doc_id for r in out} == set(need) == set(range(1, 80))
    words_missed = sum(len(need[d] - held[d]) for d in need)
    assert got <= pairs and words_missed <= 0.001 * sum(map(len, need.values()))
    assert len(got) < len(pairs) / 2


def test_pairs_that_add_no_words_are_not_aligned():
    """A known passage before words that the other text doesn't have adds none; whatever adds some is aligned."""
    both = np.arange(200) < 100
    known = np.arange(204) < 104
    last = np.full(200, -1)
    assert not ps.adding(both, last, known, 50, 5, 80)
    assert ps.adding(both, last, known & (np.arange(204) != 30), 50, 5, 80)
    rng, added, left = np.random.default_rng(5), 0, 0
    for _ in range(400):
        base = [f"w{i}" for i in rng.integers(0, 150, 160)]
        x, y = ([w if rng.random() > 0.02 else f"e{rng.integers(1000)}" for w in base[a:b]] for a, b in ((0, 120), tuple(sorted(rng.choice(161, 2, replace=False)))))
        x, y = _h(x), _h(y)
        known = np.zeros(len(y) + 4, bool)
        known[: rng.integers(0, len(known) + 1)] = True
        adds = any(not known[p.start : p.end].all() for p in ps.common_passages(x, y))
        added += adds
        if not ps.adding(ps.marked(np.sort(x), y), ps._last(y), known, 50, 5, 80):
            left += 1
            assert not adds
    assert added > 50 and left > 50


def test_bounds_on_shared_shingles():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.integers(0, rng.integers(2, 60), rng.integers(46, 91)).astype(np.uint64)
        assert ps.different(x, 46).tolist() == [len(set(x[i : i + 46].tolist())) for i in range(len(x) - 45)]
        shared = rng.random(60) < 0.8
        both, first = shared[x.astype(int)], ps._last(x) >= 0
        if both.sum() >= len(x) - 18 and 100 * len(set(x[both].tolist())) >= 80 * len(set(x.tolist())):
            assert len(set(x[both].tolist())) >= ps.fewest(x, len(set(x.tolist())), 46, 18, 80)
            assert ps.promising(both, first, np.zeros(len(x) + 4, bool), 50, 5, 80)
            assert not ps.promising(both, first, np.ones(len(x) + 4, bool), 50, 5, 80)


def test_many_texts_are_looked_at_together():
    """One answer for each text that marks a text's shingles, the same as one by one."""
    rng, seen = np.random.default_rng(5), set()
    for n in (30, 46, 47, 120, 300):
        for unknown in (0, 1, n // 3, n):
            again = rng.random(n) < 0.1
            known = np.ones(n + 4, bool)
            known[rng.permutation(n + 4)[:unknown]] = False
            both = rng.random((40, n)) < rng.choice([0.5, 0.8, 0.9, 1.0], (40, 1))
            both[::5, n // 2 :] = False
            want = [ps.promising(x, again, known, 50, 5, 80, ends=True) for x in both]
            assert ps.hopeful(both, again, known, 50, 5, 80).tolist() == want
            seen |= set(want)
    assert seen == {True, False}


def test_texts_are_read_three_times_at_most(spark):
    """Classes, first columns and the texts that are left, which are written for what comes then."""
    from gridloom.llm.ngram_join import ngram_components

    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} {i}") for i in range(20)] + [(i, f"other {i} text {i * i}") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(run, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_components(docs).collect()}
    assert all(got[i] == (0 if i < 20 else i) for i in range(40))
    assert read.value <= 3 * len(rows)


def test_bitmaps_of_a_place_are_told_once(spark):
    text = " ".join(f"w{i}" for i in range(200)).encode()
    texts = spark.createDataFrame([(1, bytearray(text))], "d long, text binary")
    places = spark.createDataFrame([(1, 100, b, 46, False) for b in (10, 20, 30)], "d long, place int, before int, after int, open boolean")
    cover = spark.createDataFrame([], "d long, spans array<struct<start:int,end:int>>")
    got = ps.surroundings(texts, places, cover, 46, 5, 80)
    assert got.where("side = 0").count() == 1
    assert got.first().least == -(-7 * (46 - ps.most_lone(46, 80)) // 8)


def test_runs_of_values_with_one_place(spark):
    a, b = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.uint32), np.array([3, 4, 9, 6, 7, 1, 2, 2], np.uint32)
    assert ps._runs(a, b, 20, 5) == [(0, 2, 2), (3, 5, 2), (5, 0, 2), (7, 1, 1)]
    assert ps._runs(np.append(a, np.uint32(1)), b, 20, 5)[:2] == [(0, 2, 2), (3, 5, 2)]  # 1 has two places
