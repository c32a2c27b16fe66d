"""Quality by positive-unlabelled learning with the non-negative risk of Kiryo and others (2017).

Trusted positives are labelled good texts, the unlabelled set is all documents without any label. A linear model over shares
of a text's characters, words and lines minimises prior * R_p+ + max(0, R_u- - prior * R_p-) for the logistic loss, by Newton
steps whose sums go over all rows; while the second part is negative, the first alone is stepped on. The class prior comes
from a first model of positives against unlabelled: over score thresholds, the least share of unlabelled to positives at or
above one (best bin estimation, Garg and others 2021), on histograms of all rows that the first model wasn't fitted on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import arrow_rows, chunks, cut, few, release, row_key
from .labels import fold
from .quality_rules import text_stats

#: Bins of the score histograms, Newton steps at most, and the ridge: of 0.0001, 0.003, 0.01, 0.03 and 0.1 that of the highest
#: accuracy over folds 1 to 4, each left out once (means over two sizes: 0.961, 0.966, 0.966, 0.982, 0.977).
BINS, STEPS, RIDGE = 1000, 15, 3e-2
_CLASSES = {
    "upper": lambda b: 0x41 <= b <= 0x5A,
    "lower": lambda b: 0x61 <= b <= 0x7A,
    "digit": lambda b: 0x30 <= b <= 0x39,
    "wide": lambda b: b >= 0x80,
    "stop": lambda b: b in b".,;:?'\"()-",
    "bang": lambda b: b == 0x21,
    "pipe": lambda b: b in b"|<>{}[]=_~^\\/",
    "mark": lambda b: b in b"#*$%&@+",
    "line": lambda b: b == 0x0A,
}
_TABLES = {k: np.array([f(b) for b in range(256)]) for k, f in _CLASSES.items()}


def text_features(texts: pa.Array) -> np.ndarray:
    """One row a text, every value from 0 to about 1."""
    data, at = tk.column_bytes(texts)
    s = text_stats(texts)

    def share(table: np.ndarray) -> np.ndarray:
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=run[1:])
        return run[at[1:]] - run[at[:-1]]

    words, size = np.maximum(s["n_words"], 1), np.maximum(np.diff(at), 1)
    out = [share(t) / size for t in _TABLES.values()]
    out += [np.sqrt(np.minimum(1, share(_TABLES[k]) / words)) for k in ("bang", "pipe", "mark")]
    repeat = s["n_repeat_words"] / words
    out += [repeat, repeat**2, np.minimum(1, 10 * s["n_dup_lines"] / words), np.minimum(1, s["word_chars"] / words / 20), np.log1p(s["n_words"]) / 12, s["n_words"] < 50, s["n_words"] == 0]
    return np.stack([np.asarray(x, np.float32) for x in out], 1)


def _logistic(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def risk_sums(x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows (the last column of x is 1): of positives and of unlabelled rows the number, logistic losses for labels
    1 and -1, x, gradient for label 1, second derivatives. Of label -1 the gradient is that of label 1 and x together."""
    out = []
    for own in (positive, ~positive):
        y = x[own]
        f = y @ w
        q = _logistic(f)
        out.append(np.concatenate([[len(y), np.logaddexp(0, -f).sum(), np.logaddexp(0, f).sum()], y.sum(0), y.T @ (q - 1), ((y.T * (q * (1 - q))) @ y).ravel()]))
    return np.concatenate(out)


def _parts(sums: np.ndarray, d: int) -> list[dict[str, np.ndarray]]:
    """Means of what risk_sums has, of positives and of unlabelled rows."""
    out = []
    for own in np.split(sums, 2):
        n = max(own[0], 1)
        x, g, h = np.split(own[3:] / n, [d, 2 * d])
        out.append({"good": own[1] / n, "bad": own[2] / n, "to_good": g, "to_bad": g + x, "second": h.reshape(d, d)})
    return out


def fit_pu(sums, d: int, prior: float, unbiased: bool = True) -> np.ndarray:
    """Weights of least non-negative risk; unbiased=False: of positives against unlabelled rows, halves each.

    sums(w) gives risk_sums over all rows, of d columns.
    """

    def at(w):
        p, u = _parts(sums(w), d)
        ridge = np.append(np.full(d - 1, RIDGE), 0)
        if not unbiased:
            risk, g, h = (p["good"] + u["bad"]) / 2, (p["to_good"] + u["to_bad"]) / 2, (p["second"] + u["second"]) / 2
        else:
            other = u["bad"] - prior * p["bad"]
            risk = prior * p["good"] + max(0.0, other)
            # with the logistic loss both of the positives' terms have the same second derivative
            g, h = (prior * (p["to_good"] - p["to_bad"]) + u["to_bad"], u["second"]) if other >= 0 else (prior * p["to_good"], prior * p["second"])
        return risk + (ridge * w * w).sum() / 2, g + ridge * w, h + np.diag(ridge + 1e-6)

    w = np.zeros(d)
    risk, g, h = at(w)
    step = 1.0
    for _ in range(STEPS):
        move = np.clip(np.linalg.solve(h, g), -5, 5)
        new = w - step * move
        there = at(new)
        if there[0] <= risk:
            done = risk - there[0] < 1e-6
            w, (risk, g, h), step = new, there, min(1.0, 2 * step)
            if done:
                break
        else:
            step /= 4
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in unlabelled rows, by numbers of both in score bins (higher: likelier positive)."""
    qp, qu = (np.cumsum(x[::-1])[::-1] / max(x.sum(), 1) for x in (p, u))
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(max(u.sum(), 1)) + 1 / np.sqrt(max(p.sum(), 1)))
    held = qp >= 0.05
    best = np.argmin(np.where(held, (qu + slack) / np.maximum(qp, 1e-9), np.inf))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.01, 0.99))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) of every row of docs.

    Positives are labelled 1 in folds 1 to 4; unlabelled rows are those of the same folds whose id has no label. Held-out
    labels and labels 0 are never read. Null and wordless texts are scored by the features of none. Repeated rows score
    alike. Without positives or without unlabelled rows every score is the prior, 0.5. Empty docs: no rows.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    names = [f"x{i}" for i in range(text_features(pa.array([b""])).shape[1])]

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                x = text_features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), *(pa.array(c) for c in x.T.copy())], names=["k", "doc_id", *names])

    rows = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kinds = ", ".join(f"{n} float" for n in names)
    read = cut(rows.mapInArrow(run, f"k long, doc_id long, {kinds}"), "features")
    known = few(labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label).alias("label"), F.lit(True).alias("listed")))
    train = read.where(fold("doc_id") != 0).join(known, "doc_id", "left").where("listed is null or label = 1")
    train = cut(train.select(F.col("listed").isNotNull().alias("positive"), (F.pmod(F.xxhash64("k"), F.lit(2)) == 0).alias("half"), *names), "train")
    d = len(names) + 1
    columns = lambda batch: np.stack([np.asarray(batch.column(n)) for n in names], 1).astype(np.float64)
    mean, scale = np.zeros(d - 1), np.ones(d - 1)

    def scaled(batch):
        return np.hstack([(columns(batch) - mean) / scale, np.ones((batch.num_rows, 1))])

    def summed(rows, f, size) -> np.ndarray:
        """The sum of f(batch), a vector, over all rows: a vector comes from each task."""

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                total += f(batch)
            yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]})

        return sum((np.frombuffer(r.s) for r in rows.mapInArrow(run, "s binary").collect()), np.zeros(size))

    def moments(batch):
        x = columns(batch)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    def fit(rows, prior, unbiased=True):
        def sums(w):
            return summed(rows, lambda batch: risk_sums(scaled(batch), np.asarray(batch.column("positive").cast(pa.uint8())) > 0, w), 2 * (3 + 2 * d + d * d))

        w = fit_pu(sums, d, prior, unbiased)
        out = np.append(w[:-1] / scale, w[-1])
        out[-1] -= (out[:-1] * mean).sum()
        return out

    def scores(w):
        return 1 / (1 + F.exp(-sum((F.col(n).cast("double") * float(x) for n, x in zip(names, w, strict=False)), F.lit(float(w[-1])))))

    n = {r.positive: r["count"] for r in train.groupBy("positive").count().collect()}
    if min(n.get(True, 0), n.get(False, 0)) > 3:
        got = summed(train.where("not positive"), moments, 2 * d - 1)
        mean = got[1:d] / got[0]
        scale = np.sqrt(np.maximum(got[d:] / got[0] - mean**2, 0)) + 1e-3
        # one half estimates the prior with what the other was fitted on; the last fit has all
        first = fit(train.where("half"), 0.5, unbiased=False)
        bins = train.where("not half").groupBy("positive", F.floor(scores(first) * (BINS - 1e-6)).cast("int").alias("bin")).count().collect()  # at most 2 x BINS rows
        held = np.zeros((2, BINS))
        for r in bins:
            held[int(r.positive), r.bin] = r["count"]
        weights = fit(train, estimate_prior(held[1], held[0]))
    else:
        weights = np.zeros(d)
    release(train)
    return read.select(F.col("doc_id"), (fold("doc_id") == 0).alias("held_out"), scores(weights).alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
