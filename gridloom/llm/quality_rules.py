"""Quality rules: base rules over statistics of each text, and an isolation forest over the same statistics.

The forest follows Liu, Ting and Zhou (2008): random splits of small samples, and a text's anomaly score 2^(-mean path
length / c(sample size)). The threshold comes from all labelled rows: over the whole range of scores, the one with the
best balance between labelled good texts kept and labelled bad ones found, among those that keep nearly all good texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import arrow_rows, chunks
from .labels import sample

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Rows of the forest's sample, trees, rows per tree, share of labelled good texts that a threshold has to keep.
SAMPLE_ROWS, TREES, TREE_ROWS, KEEP_GOOD = 20_000, 100, 256, 0.99
_BINS = 1000
#: Mean word length and number of words that are 1 on the scale of features.
LONG_WORD, LONG_TEXT = 20, 1e6
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text of a binary column."""
    w = tk.words(texts)
    n = len(w.first) - 1
    code = np.zeros(len(w.data) + 1, np.int64)  # code points begun before each byte
    np.cumsum((w.data & 0xC0) != 0x80, out=code[1:])
    word_chars = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(code[w.end] - code[w.start], out=word_chars[1:])

    def by_text(mark: np.ndarray) -> np.ndarray:
        run = np.zeros(len(mark) + 1, np.int64)
        np.cumsum(mark, out=run[1:])
        return run[w.text_at[1:]] - run[w.text_at[:-1]]

    # lines: what \n or a text's end closes
    cut = np.unique(np.concatenate([np.flatnonzero(w.data == 0x0A) + 1, w.text_at[1:]]))
    begin = np.concatenate([[0], cut[:-1]])
    close = cut - (np.append(w.data, 0)[np.maximum(cut - 1, 0)] == 0x0A) * (cut > begin)
    held = np.searchsorted(w.start, close) > np.searchsorted(w.start, begin)
    begin, close = begin[held], close[held]
    owner = np.searchsorted(w.text_at, begin, "right") - 1
    lines = tk.mix(tk.hash_spans(w.sums, begin, close) + owner.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, first = np.unique(lines, return_index=True)
    dup = np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)

    # words in 3-word windows that stand twice or more in their text
    covered = np.zeros(len(w.start) + 2, bool)
    text = w.text_of_word()
    if len(w.start) >= 3:
        at = np.flatnonzero(text[:-2] == text[2:])
        h = np.zeros(len(at), np.uint64)
        for i in range(3):
            h += w.hash[at + i] * np.uint64(pow(tk._P, i + 1, 1 << 64))
        h = tk.mix(h + text[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for i in range(3):
            covered[at[twice] + i] = True
    repeat = np.bincount(text[covered[: len(text)]], minlength=n)
    counts = w.counts()
    return dict(zip(STATS, (counts, word_chars[w.first[1:]] - word_chars[w.first[:-1]], by_text(SYMBOLS[w.data]), dup, repeat), strict=True))


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of every whole text; a null text has no words. Repeated and null ids keep their rows."""
    arrow_rows(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                got = text_stats(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(got[n].astype(np.int64)) for n in STATS)], names=["doc_id", *STATS])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in STATS))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits, each from 0 to 1: shares of symbols, repeated lines and repeated words, word length, length.

    A few repeats are no fault: their shares are squared, so that cuts drawn evenly over a range seldom part small values from
    none; a root spreads the symbols of tables and of junk from plain text. The text's length is on a log scale.
    """
    f = {k: np.asarray(v, np.float64) for k, v in s.items()}
    words = np.maximum(f["n_words"], 1)
    return np.stack([np.sqrt(np.minimum(1, f["n_symbols"] / words)), np.minimum(1, 10 * f["n_dup_lines"] / words) ** 2, (f["n_repeat_words"] / words) ** 2, np.minimum(1, f["word_chars"] / words / LONG_WORD), np.minimum(1, np.log1p(f["n_words"]) / np.log(LONG_TEXT))], 1)


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), cut, left child (right is the next), path length added at a leaf."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    left: list[np.ndarray]
    depth: list[np.ndarray]
    c: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut, left, depth in zip(self.feature, self.cut, self.left, self.depth, strict=True):
            at = np.zeros(len(x), np.int64)
            while (go := f[at] >= 0).any():
                i = at[go]
                at[go] = left[i] + (x[go, f[i]] >= cut[i])
            total += depth[at]
        return 2.0 ** (-total / max(1, len(self.feature)) / self.c)


def _c(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def fit_forest(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 0) -> Forest:
    """An isolation forest over the rows of x, of values from 0 to 1; no rows: every score is that of a lone row.

    Cuts are drawn over the whole range, not over what a node's rows span: a value that no fitted row comes near falls to
    an empty side after few splits, even where all fitted rows are alike.
    """
    rng = np.random.default_rng(seed)
    out = Forest([], [], [], [], max(_c(min(rows, len(x))), 1e-9) if len(x) > 1 else 1.0)
    for _ in range(trees if len(x) else 0):
        own = x[rng.choice(len(x), min(rows, len(x)), replace=False)]
        top = int(np.ceil(np.log2(max(2, len(own)))))
        feature, cut, left, depth, todo = [-1], [0.0], [0], [0.0], [(0, own, 0)]
        while todo:
            k, part, d = todo.pop()
            if d >= top or len(part) < 2:
                depth[k] = d + _c(len(part))
                continue
            f = int(rng.integers(x.shape[1]))
            at = rng.uniform()
            feature[k], cut[k], left[k] = f, at, len(feature)
            for side in (part[part[:, f] < at], part[part[:, f] >= at]):
                todo.append((len(feature), side, d + 1))
                feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0)
        out.feature.append(np.array(feature)), out.cut.append(np.array(cut)), out.left.append(np.array(left)), out.depth.append(np.array(depth))
    return out


def pick_threshold(bins: list[tuple[int, int, int]], keep_good: float = KEEP_GOOD) -> float:
    """bins: (score bin, good rows, bad rows). The cut of best balance among those that keep `keep_good` of the good rows.

    Without good or bad rows nothing is anomalous.
    """
    good, bad = np.zeros(_BINS + 2), np.zeros(_BINS + 2)
    for b, g, x in bins:
        good[b] += g
        bad[b] += x
    if not good.sum() or not bad.sum():
        return float("inf")
    kept, found = np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    fit = np.flatnonzero(kept >= keep_good)
    best = fit[np.argmax((kept + found)[fit])]
    return (best + 1) / _BINS


def judge(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, seed: int = 0) -> DataFrame:
    """stats (a written table with STATS) with anomaly (the forest's score), base_failed and kept.

    labels: doc_id and quality (1 good, 0 bad, else unlabelled). The forest is fitted on about sample_rows labelled good rows
    at most that pass the base rules, those of the least hashes; every row is scored, and the threshold is set over all
    labelled rows that pass. No labels or an empty table: only the base rules decide.
    """
    spark = stats.sparkSession
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).where("_q in (0, 1)").distinct()
    drawn = stats.where("not base_failed").join(known.where("_q = 1"), F.col("doc_id") == F.col("_id"))
    drawn = sample(drawn, F.xxhash64("doc_id", *STATS), sample_rows).select(*STATS).toPandas()
    forest = spark.sparkContext.broadcast(fit_forest(features({n: drawn[n].to_numpy() for n in STATS}), trees, seed=seed))
    names = stats.columns

    def run(batches):
        for batch in batches:
            s = forest.value.score(features({n: np.asarray(batch.column(n)) for n in STATS}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*names, "anomaly"])

    scored = stats.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields) + ", anomaly double")
    bins = scored.where("not base_failed").select("doc_id", "anomaly").join(known, F.col("doc_id") == F.col("_id")).groupBy(F.ceil(F.col("anomaly") * _BINS).cast("int").alias("b")).agg(F.sum("_q").alias("g"), F.sum(1 - F.col("_q")).alias("x"))
    threshold = pick_threshold([(r.b, r.g, r.x) for r in bins.collect()])  # at most _BINS + 1 rows
    return scored.withColumn("kept", ~F.col("base_failed") & (F.ceil(F.col("anomaly") * _BINS) / _BINS < F.lit(threshold)))
