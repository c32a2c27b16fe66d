"""Toxicity by class-conditional Kneser-Ney bigram models.

For each class c of labelled texts P_c(w|u) = max(n_c(u,w) - D_c, 0) / n_c(u) + rest_c(u) P_c(w), and P_c(w) is a mixture of
the discounted N_c(.w) / N_c(..), which counts types (different neighbours), and the same of both classes together. The last
and that mixture are the backoff counts that the classes share, so a rare word or expression weighs little. Discounts are Chen
and Goodman's modified ones, each from the counts of counts; pairs that neither class has CUTOFF times, most of all, leave
their mass to the backoff. A text's evidence is the difference of its log-likelihoods a word; beside it stands the same
difference of the backoff level alone, of which only what a word has beyond TELLING of the largest one counts, as a few words
in a long ordinary text hardly move the mean. A logistic curve over both, fitted on a fold of labelled texts that the counts
don't see, gives the score. The second part is what tells where toxic texts are ordinary ones with a few toxic words: on 0.1
of the test tables the AUC of the first alone is 0.60. Pooling the whole difference over a text's largest shares, or over what
words have beyond a threshold, has an AUC of 0.96 there, but recalls 0.81 of the toxic texts at a precision of 0.85, against
0.92 and 1.00 so.

Words, contexts and pairs are kept exactly (by 64-bit hashes) and all of them: the model grows with the labelled texts. Its
values are worked out in packed blocks by the workers and dealt by hash into parts of about MODEL_BYTES. The driver has one
part at a time, while it sends it; a worker has all of them and reads a text once: evidence is a sum over words and pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import textkernel as tk
from .common import arrow_rows, chunks, cut, give_back, release, row_key, slices
from .labels import FIT_ROWS, fit_logistic, fold, labelled, sample

#: Least count of a pair, in either class, that the model keeps, the shared part of P_c(w), the part of the largest difference beyond which a
#: word is telling.
CUTOFF, SHARE, TELLING = 3, 0.8, 0.5
#: Different pairs of a block, about; bytes of a part of the model, which the driver has at once.
BLOCK, MODEL_BYTES = 1 << 18, 8 << 20
#: Words: runs of 0-9, a-z (A-Z lower-cased) and bytes beyond ASCII.
LETTERS = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
_START = np.uint64(0x2545F4914F6CDD1D)
#: Words that a task gathers before it counts their pairs; rows of a lookup that are put in at once; bytes sent on at once.
_FLUSH, _BUILD, _SENT = 1 << 18, 1 << 18, 4 << 20


def bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word's context (the word before; a text's start) and of the word, and each text's first word."""
    w = tk.words(texts, lower=True, table=LETTERS)
    context = np.concatenate([[_START], w.hash[:-1]])[: len(w.hash)]
    context[w.first[:-1][np.diff(w.first) > 0]] = _START
    return context, w.hash, w.first


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tk.mix(context * np.uint64(tk._P) + word)


class Lookup:
    """Rows of values by 64-bit hash, in an open hash table; `other` stands for hashes that it doesn't have.

    The table, of places in the rows, is made where rows are first looked up, so the driver only has and sends the rows.
    """

    def __init__(self, key: np.ndarray, values: np.ndarray, other):
        self.key, self.bits = key, 0
        self.values = np.empty((len(key) + 1, len(other)), np.float32)
        self.values[:-1], self.values[-1] = values, other

    def _build(self) -> None:
        self.bits = max(4, int(2 * len(self.key)).bit_length())
        self.row = np.full(1 << self.bits, -1, np.int32)
        for low in range(0, len(self.key), _BUILD):  # a part after the other, as sorting takes several times its size
            left = np.arange(low, min(len(self.key), low + _BUILD), dtype=np.int32)
            while len(left):
                at, one = np.unique(self._slots(self.key[left]), return_index=True)
                self.row[at] = left[one]
                left = np.delete(left, one)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        far = np.arange(len(h))
        while len(far := far[self._taken(self.row[at[far]], h[far])]):
            at[far] = (at[far] + 1) & ((1 << self.bits) - 1)
        return at

    def _taken(self, row: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether a slot's row is there and is another hash's."""
        out = row >= 0
        out[out] = self.key[row[out]] != h[out]
        return out

    def rows(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash; -1, the last row, if there is none."""
        if not self.bits:
            self._build()
        return self.row[self._slots(h)]


def _dealt(key: np.ndarray, parts: int) -> list:
    """Places of the hashes of each part, found by one sort, so that a text's work doesn't grow with the number of parts."""
    if parts == 1:
        return [slice(None)]
    part = (key % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    return [order[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@dataclass
class Model:
    words: Lookup  #: by word: log P_1(w) - log P_0(w), and as a context: log rest_1(u) - log rest_0(u)
    pairs: Lookup  #: what a kept pair's log P_1(w|u) - log P_0(w|u) has beyond the two of its word and context
    part: tuple[int, int]  #: has words and pairs whose hash has this remainder by this number
    limit: float  #: log P_1(w) - log P_0(w) beyond which a word is telling

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, what this part adds to the sum of log P_1 - log P_0, and to the sum of telling differences."""
        return evidence([self], texts)


def evidence(parts: list[Model], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the sum of log P_1 - log P_0 over them, and the sum of telling differences, of these parts."""
    context, word, first = bigrams(texts)
    pair, many = pair_hash(context, word), np.diff(first)
    begins, ends = first[:-1][many > 0], first[1:][many > 0] - 1
    follows = np.ones(len(word))  # a text's last word is no context
    follows[ends] = 0
    x, telling = np.zeros(len(word)), np.zeros(len(word))
    number = parts[0].part[1]
    own_words, own_pairs = _dealt(word, number), _dealt(pair, number)
    for m in parts:
        at = own_words[m.part[0]]
        value = m.words.values[m.words.rows(word[at])].astype(np.float64)
        telling[at] = np.maximum(value[:, 0] - m.limit, 0)
        x[at] += value[:, 0] + value[:, 1] * follows[at]
        if int(_START) % number == m.part[0]:
            x[begins] += m.words.values[m.words.rows(np.array([_START]))[0], 1]
        at = own_pairs[m.part[0]]
        x[at] += m.pairs.values[m.pairs.rows(pair[at]), 0]
    sums = []
    for y in (x, telling):
        run = np.concatenate([[0], np.cumsum(y)])
        sums.append(run[first[1:]] - run[first[:-1]])
    return many, *sums


def discounts(times: np.ndarray) -> np.ndarray:
    """Chen and Goodman's discounts of counts 1, 2, and 3 or more, given how many different things have a count of 1, 2, 3, 4.

    Each is kept between a tenth of the count and just below it; where counts of counts lack, it is half of the count.
    """
    n = np.maximum(np.asarray(times, np.float64), 0)
    y = n[0] / max(n[0] + 2 * n[1], 1)
    return np.array([np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.1 * k, 0.98 * k) if n[k - 1] else 0.5 * k for k in (1, 2, 3)])


def _less(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts without their discounts; 0 stays 0."""
    return np.maximum(counts - np.concatenate([[0], d])[np.minimum(counts, 3)], 0)


def _rows(step: int, block: np.ndarray, hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (step, block, n, data): data has n values of each column of hashes, then of counts."""
    order = np.argsort(block, kind="stable")
    ids, at = np.unique(block[order], return_index=True)
    ends = np.append(at[1:], len(order))[: len(at)]
    data = [b"".join([h[order[a:b]].astype("<u8").tobytes() for h in hashes] + [c[order[a:b]].astype("<i4").tobytes() for c in counts]) for a, b in zip(at, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), step), pa.int64()), pa.array(ids.astype(np.int64)), pa.array(ends - at), pa.array(data, pa.binary())], names=["step", "block", "n", "data"])


def _columns(n: int, data: bytes, hashes: int, counts: int) -> list[np.ndarray]:
    return [np.frombuffer(data, "<u8", n, 8 * n * i) for i in range(hashes)] + [np.frombuffer(data, "<i4", n, 8 * n * hashes + 4 * n * i) for i in range(counts)]


def _together(table: pa.Table, hashes: int, counts: int) -> list[np.ndarray]:
    parts = [_columns(n, d.as_py(), hashes, counts) for n, d in zip(table.column("n").to_pylist(), table.column("data"), strict=True)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


_KIND = "step long, block long, n long, data binary"
#: What rows have: counts of pairs; kept pairs; contexts of kept pairs; how many pairs have a count of 1, 2, 3, 4 and more by
#: class; types of words; words with their types by class and in both; the same hows-many of types; sums of types; words with
#: log P_1 - log P_0; kept pairs with their words' P_0 and P_1.
_PAIRS, _KEPT, _CONTEXTS, _PAIR_TIMES, _TYPES, _WORDS, _WORD_TIMES, _SUMS, _LEVELS, _LEVELLED = range(10)


def _times(step: int, block: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    many = np.stack([np.bincount(np.minimum(c, 5), minlength=6)[1:] for c in columns])
    return _rows(step, np.array([block]), [], [m[None] for m in many.ravel()])


def count_pairs(train: DataFrame) -> DataFrame:
    """The counted rows (see above) of train's rows (text, label), written."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = np.uint64(64 - min(16, max(4, int(size // 8 // BLOCK).bit_length())))

    def count(batches):
        got: list[tuple[np.ndarray, ...]] = []

        def flush():
            context, word, label = (np.concatenate(c) for c in zip(*got, strict=True))
            got.clear()
            _, one, back = np.unique(pair_hash(context, word), return_index=True, return_inverse=True)
            n = [np.bincount(back[label == c], minlength=len(one)) for c in (0, 1)]
            out = _rows(_PAIRS, context[one] >> bits, [context[one], word[one]], n)
            return slices(out, max(1, _SENT * out.num_rows // max(1, out.nbytes)))

        for whole in batches:
            for batch in chunks(whole, "text"):
                context, word, first = bigrams(batch.column("text"))
                got.append((context, word, np.repeat(np.asarray(batch.column("label")).astype(np.int8), np.diff(first))))
                if sum(len(g[0]) for g in got) > _FLUSH:
                    yield from flush()
        if sum(len(g[0]) for g in got):
            yield from flush()

    def by_context(key, table):
        context, word, *n = _together(table, 2, 2)
        _, one, back = np.unique(pair_hash(context, word), return_index=True, return_inverse=True)
        context, word, n = context[one], word[one], [np.bincount(back, c, len(one)).astype(np.int64) for c in n]
        kept = np.maximum(*n) >= CUTOFF
        ids, back = np.unique(context, return_inverse=True)
        total = [np.bincount(back, c, len(ids)).astype(np.int64) for c in n]
        own = np.zeros(len(ids), bool)
        own[back[kept]] = True
        words, of = np.unique(word, return_inverse=True)
        types = [np.bincount(of, x, len(words)).astype(np.int64) for x in (n[0] > 0, n[1] > 0, np.ones(len(word)))]
        return pa.Table.from_batches([_rows(_KEPT, word[kept] >> bits, [context[kept], word[kept]], [c[kept] for c in n]), _rows(_CONTEXTS, ids[own] >> bits, [ids[own]], [t[own] for t in total]), _times(_PAIR_TIMES, key[0].as_py(), n), _rows(_TYPES, words >> bits, [words], types)])

    def by_word(key, table):
        word, *types = _together(table, 1, 3)
        ids, back = np.unique(word, return_inverse=True)
        types = [np.bincount(back, c, len(ids)).astype(np.int64) for c in types]
        sums = np.array([t.sum() for t in types])  # in two halves, as counts have 32 bits
        return pa.Table.from_batches([_rows(_WORDS, ids >> bits, [ids], types), _times(_WORD_TIMES, key[0].as_py(), types), _rows(_SUMS, np.array([key[0].as_py()]), [], [x[None] for x in (*(sums >> 24), *(sums & 0xFFFFFF))])])

    pairs = cut(train.select("text", "label").mapInArrow(count, _KIND).groupBy("block").applyInArrow(by_context, _KIND), "contexts")
    words = pairs.where(f"step = {_TYPES}").groupBy("block").applyInArrow(by_word, _KIND)
    out = cut(pairs.where(f"step <> {_TYPES}").union(words), "counts")
    release(pairs)
    out._block_bits = int(bits)
    return out


def _of(table: pa.Table, step: int, hashes: int, counts: int) -> list[np.ndarray]:
    """The columns of a step's rows; none: empty ones."""
    rows = table.filter(pa.array(np.asarray(table.column("step")) == step))
    return _together(rows, hashes, counts) if rows.num_rows else [np.zeros(0, np.uint64)] * hashes + [np.zeros(0, np.int32)] * counts


def _summed(counts: DataFrame) -> dict[int, np.ndarray]:
    """Sums over all blocks of the hows-many and of the sums of types: a row a task and step comes to the driver."""
    widths = {_PAIR_TIMES: 10, _WORD_TIMES: 15, _SUMS: 6}

    def add(batches):
        got = {s: np.zeros(n, np.int64) for s, n in widths.items()}
        for batch in batches:
            for step, data in zip(batch.column("step").to_pylist(), batch.column("data"), strict=True):
                got[step] += np.frombuffer(data.as_py(), "<i4")
        yield pa.RecordBatch.from_pydict({"step": list(got), "data": [x.tobytes() for x in got.values()]})

    out = {s: np.zeros(n, np.int64) for s, n in widths.items()}
    for r in counts.where(F.col("step").isin(list(widths))).select("step", "data").mapInArrow(add, "step long, data binary").collect():
        out[r.step] += np.frombuffer(r.data, np.int64)
    return out


def models(counts: DataFrame, most: int = MODEL_BYTES):
    """The model that counted rows make, in parts of about `most` bytes one after another. No rows: all words are alike.

    log P_1(w|u) - log P_0(w|u) is a sum of what the word, its context and, if it is kept, the pair give. Words' levels are
    worked out beside the words, then contexts and pairs beside the contexts; the driver sees sums, and one part at a time.
    """
    bits, sums = np.uint64(counts._block_bits), _summed(counts)
    times, total = sums[_WORD_TIMES].reshape(3, 5), sums[_SUMS][:3] * (1 << 24) + sums[_SUMS][3:]
    d_pair, d_word = [discounts(t) for t in sums[_PAIR_TIMES].reshape(2, 5)], [discounts(t) for t in times]
    taken = [t[0] * d[0] + t[1] * d[1] + t[2:].sum() * d[2] for t, d in zip(times, d_word, strict=True)]
    sizes = {r.step: r.n for r in counts.groupBy("step").agg(F.sum("n").alias("n")).collect()}
    parts = max(1, -(-(16 * sizes.get(_WORDS, 0) + 12 * sizes.get(_KEPT, 0)) // most))
    even = 1 / (sizes.get(_WORDS, 0) + 1)  # what discounts take off goes evenly to all words and one that no text has

    def backed(c: int, types: np.ndarray, shared):
        """Discounted shares of the types of class c (2: both), what is taken off going by `shared`; no types: `shared`."""
        return (_less(types, d_word[c]) + taken[c] * shared) / total[c] if total[c] else shared

    def level(types: list[np.ndarray]) -> list[np.ndarray]:
        """P_0 and P_1 of words."""
        both = backed(2, types[2], np.full(len(types[2]), even))
        return [(1 - SHARE) * backed(c, types[c], both) + SHARE * both for c in (0, 1)]

    unseen = level([np.zeros(1, np.int64)] * 3)
    other = float(np.log(unseen[1] / unseen[0])[0])

    def levels(key, table):
        word, *types = _of(table, _WORDS, 1, 3)  # a row a block, in order
        p = level(types)
        of, own, *n = _of(table, _KEPT, 2, 2)
        at = np.searchsorted(word, own)
        return pa.Table.from_batches([_rows(_LEVELS, word >> bits, [word, np.log(p[1] / p[0]).view(np.uint64)], []), _rows(_LEVELLED, of >> bits, [of, own, *(x[at].view(np.uint64) for x in p)], n)])

    def largest(batches):
        got = [np.frombuffer(d.as_py(), "<f8", n, 8 * n).max() for b in batches for n, d in zip(b.column("n").to_pylist(), b.column("data"), strict=True)]
        yield pa.RecordBatch.from_pydict({"most": np.array([max(got)] if got else [])})

    def values(key, table):
        word, g = _of(table, _LEVELS, 2, 0)
        context, *n_context = _of(table, _CONTEXTS, 1, 2)
        of, own, *p, n0, n1 = _of(table, _LEVELLED, 4, 2)
        order = np.argsort(context)
        context, n_context = context[order], [n[order] for n in n_context]
        at, p = np.searchsorted(context, of), [x.view(np.float64) for x in p]
        mass = [_less(n, d) / np.maximum(t[at], 1) for n, d, t in zip((n0, n1), d_pair, n_context, strict=True)]
        rest = [1 - np.bincount(at, m, len(context)) for m in mass]
        weight = np.log(rest[1] / rest[0])
        whole = [m + r[at] * x for m, r, x in zip(mass, rest, p, strict=True)]
        beyond = np.log(whole[1] / whole[0]) - weight[at] - np.log(p[1] / p[0])
        keys, pair = np.union1d(word, context), pair_hash(of, own)
        alone, before = np.full(len(keys), other, np.float32), np.zeros(len(keys), np.float32)
        alone[np.searchsorted(keys, word)] = g.view(np.float64)
        before[np.searchsorted(keys, context)] = weight
        part = lambda k: k % np.uint64(parts)
        return pa.Table.from_batches([_rows(_WORDS, part(keys), [keys], [alone.view(np.int32), before.view(np.int32)]), _rows(_KEPT, part(pair), [pair], [beyond.astype(np.float32).view(np.int32)])])

    levelled = cut(counts.where(F.col("step").isin(_KEPT, _WORDS)).groupBy("block").applyInArrow(levels, _KIND), "levels")
    highest = max([other, *(r.most for r in levelled.where(f"step = {_LEVELS}").select("n", "data").mapInArrow(largest, "most double").collect())])
    limit = TELLING * highest if highest > 0 else np.inf
    rows = cut(levelled.union(counts.where(f"step = {_CONTEXTS}")).groupBy("block").applyInArrow(values, _KIND), "values")
    release(levelled)
    at, stream = 0, rows.repartitionByRange(parts, "block").sortWithinPartitions("block").toLocalIterator()

    def model(part: int, got: list[tuple]) -> Model:
        def lookup(step: int, columns: int, none: list[float]) -> Lookup:
            each = [_columns(n, data, 1, columns) for s, n, data in got if s == step]
            key, *value = (np.concatenate(c) for c in zip(*each, strict=True)) if each else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int32)] * columns
            return Lookup(key, np.stack([v.view(np.float32) for v in value], 1), none)

        return Model(lookup(_WORDS, 2, [other, 0]), lookup(_KEPT, 1, [0]), (part, parts), limit)

    for part, own in groupby(stream, lambda r: r.block):
        while at < part:
            yield model(at, [])
            at += 1
        yield model(part, [(r.step, r.n, bytes(r.data)) for r in own])
        at = part + 1
    for part in range(at, parts):
        yield model(part, [])
    release(rows)


def _evidence(docs: DataFrame, parts: list, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, n_words, evidence and telling: texts are read once, whatever the number of parts."""
    kinds = dict(docs.dtypes)

    def run(batches):
        own = [m.value for m in parts]
        for whole in batches:
            for batch in chunks(whole, "text"):
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *map(pa.array, evidence(own, batch.column("text")))], names=[*keep, "n_words", "evidence", "telling"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", n_words long, evidence double, telling double")


def _curve(n: np.ndarray, *sums: np.ndarray) -> np.ndarray:
    """What the logistic curve reads: each sum a word, and against the noise that a text of n words has."""
    n = np.maximum(n, 1)
    return np.stack([x / d for x in sums for d in (n, np.sqrt(n))], 1)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", model_bytes: int = MODEL_BYTES) -> DataFrame:
    """k, doc_id, held_out, score, predicted, n_words, evidence, telling of every row of docs; k is its row_key.

    Labels of folds 2 to 4 are counted, fold 1 sets the curve (FIT_ROWS rows at most, by hash), fold 0 is never read. Null,
    empty or wordless texts get the curve's value at no evidence. Repeated rows score alike. Without labels every score is
    0.5; labels of unknown documents and values other than 0 and 1 don't count. Empty docs: no rows.

    The model stays with the session for as long as the result may be read; `forget` lets go of it.
    """
    spark: SparkSession = docs.sparkSession
    arrow_rows(spark)
    known = labelled(docs, labels, label, text_col, id_col)
    counts = count_pairs(known.where("fold > 1"))
    parts = list(map(spark.sparkContext.broadcast, models(counts, model_bytes)))  # no part stays while the next is made
    release(counts)
    give_back()
    fit = _evidence(sample(known.where("fold = 1"), F.xxhash64("doc_id"), FIT_ROWS), parts, ["k", "doc_id", "label"]).toPandas()
    *weights, base = map(float, fit_logistic(_curve(*(fit[c].to_numpy() for c in ("n_words", "evidence", "telling"))), fit.label.to_numpy(np.float64)))
    rows = docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    n = F.greatest("n_words", F.lit(1))
    read = [F.col(c) / d for c in ("evidence", "telling") for d in (n, F.sqrt(n))]
    score = 1 / (1 + F.exp(-sum((F.lit(w) * x for w, x in zip(weights, read, strict=True)), F.lit(base))))
    out = _evidence(rows, parts, ["k", "doc_id"]).withColumn("score", score)
    out = out.select("k", "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "evidence", "telling")
    out._model = parts
    return out


def forget(scored: DataFrame) -> None:
    """Takes the model of a result of toxicity, which can't be read after that, from the driver and the executors."""
    for part in scored._model:
        part.destroy()
