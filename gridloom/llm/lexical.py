"""Ranked lexical search: an index of compressed postings in shards, merged document by document.

A shard is what a task reads of some megabytes of text. Its documents are numbered in the order of doc_id, and each of its
terms has one row of postings: pairs of (distance to the document before, occurrences) as variable-length integers. One more
row, of the empty term, lists the shard's documents. A search takes the postings of its items' terms, sums up the terms'
documents over all shards, and in each shard merges an item's k postings document by document: a heap holds the next
document of each, and what lies within the next WINDOW documents is taken from all that have it, so these are complete. A
second heap, bounded, keeps the best by (score, doc_id); the shards' best are merged at the end.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textkernel as tk
from .common import arrow_rows, cut, few, give_back, row_key, slices

#: Bytes of text of a shard, about (a longer text is one alone); documents that are merged at once; items of a block.
SHARD_BYTES, WINDOW, ITEMS = 4 << 20, 4096, 256
#: Bytes that belong to terms: digits, letters and all of other scripts.
TERM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "shard long, term string, n_docs long, n_terms long, data binary"


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values (seven bits each, the lowest first; the top bit says that more follow) and n + 1 places in them."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for i in range(1, 10):
        size += values >= np.uint64(1 << (7 * i)) if 7 * i < 64 else 0
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    for i in range(int(size.max(initial=0))):
        own = size > i
        out[at[:-1][own] + i] = ((values[own] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | np.where(size[own] > i + 1, 128, 0).astype(np.uint8)
    return out, at


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first) if len(raw) else np.zeros(0, np.int64)


def _same_bytes(w: tk.Words, like: np.ndarray) -> bool:
    """Whether each word has the bytes of the word whose place is in `like`."""
    size = w.end - w.start
    if not np.array_equal(size, size[like]):
        return False
    eight = np.ndarray(len(w.data), "<u8", np.concatenate([w.data, np.zeros(8, np.uint8)]), strides=(1,)) if len(w.data) else np.zeros(0, "<u8")
    own = np.arange(len(size))
    for at in range(0, int(size.max(initial=0)), 8):
        own = own[size[own] > at]
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(size[own] - at, 8).astype(np.uint64)))
        if ((eight[w.start[own] + at] ^ eight[w.start[like[own]] + at]) & mask).any():
            return False
    return True


def _numbered_terms(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's term, as a number from 0, and of each term a word: by hash, and by bytes should a hash be shared."""
    order = np.argsort(w.hash)
    held = w.hash[order]
    new = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.zeros(0, bool)
    term = np.empty(len(order), np.int64)
    term[order] = np.cumsum(new) - 1
    rep = order[new]
    if not _same_bytes(w, rep[term] if len(rep) else term):
        data, seen = w.data.tobytes(), {}
        term = np.array([seen.setdefault(data[s:e], len(seen)) for s, e in zip(w.start, w.end, strict=True)], np.int64)
        rep = np.unique(term, return_index=True)[1]
    return term, rep


def shard_rows(ids: pa.Array, texts: pa.Array, shard: int) -> pa.RecordBatch:
    """The index rows of a shard."""
    known = np.asarray(ids.is_valid())
    doc_id = np.asarray(ids.fill_null(0)).astype(np.int64)
    order = np.lexsort((doc_id, ~known))  # rows without an id come last
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    w = tk.words(texts, lower=True, table=TERM)
    n = w.counts()
    term, rep = _numbered_terms(w)
    pairs = term * len(order) + number[w.text_of_word()]
    pairs.sort()
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(pairs)))
    term, doc = np.divmod(pairs[first], max(len(order), 1))
    begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    step = doc.copy()
    step[1:] -= doc[:-1]
    step[begins] = doc[begins]
    data, at = varints(np.column_stack([step, tf]).ravel())
    ends = np.append(begins, len(term))
    names = w.data.tobytes()
    listed = np.concatenate([doc_id[order].view(np.uint8), n[order].astype("<i8").view(np.uint8), known[order].view(np.uint8)]).tobytes()
    column = lambda head, rest: pa.array(np.concatenate([[head], rest]).astype(np.int64))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(rep) + 1, shard, np.int64)),
        pa.array([""] + [names[s:e].decode("utf-8", "replace") for s, e in zip(w.start[rep], w.end[rep], strict=True)]),
        column((n > 0).sum(), np.diff(ends)),
        column(n.sum(), np.add.reduceat(tf, begins) if len(tf) else tf),
        pa.array([listed] + [data[s:e].tobytes() for s, e in zip(at[2 * ends[:-1]], at[2 * ends[1:]], strict=True)], pa.binary()),
    ], names=["shard", "term", "n_docs", "n_terms", "data"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all rows of docs, written to the shared folder: no exchange, as a shard is what one task reads.

    Terms are runs of ASCII letters, digits and characters of other scripts, A-Z lower-cased. Null, empty and termless texts
    are listed, but have no postings. Repeated rows are documents of their own. Empty docs: no rows.
    """
    arrow_rows(docs.sparkSession, 5000)

    def run(batches):
        def row():
            nonlocal shard
            shard += 1
            table = pa.Table.from_batches(held).combine_chunks()
            return shard_rows(table.column("doc_id").combine_chunks(), table.column("text").combine_chunks(), shard)

        shard, held, size = (TaskContext.get().partitionId() << 32) - 1, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= SHARD_BYTES:
                yield from slices(row())
                held, size = [], 0
                give_back()
        if held:
            yield from slices(row())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return cut(rows.mapInArrow(run, INDEX), "index")


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(PATTERN), F.lit(0))


def best_of(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best: lists are (documents ascending, scores) of each term; ties go to the lesser document."""
    cursors = [(int(docs[0]), i) for i, (docs, _) in enumerate(lists) if len(docs)]
    heapq.heapify(cursors)
    at, best = [0] * len(lists), []  # best: a heap of (score, -document)
    while cursors:
        low = cursors[0][0]
        scores = np.zeros(WINDOW, np.int64)
        while cursors and cursors[0][0] < low + WINDOW:
            i = cursors[0][1]
            docs, own = lists[i]
            end = int(np.searchsorted(docs, low + WINDOW))
            scores[docs[at[i] : end] - low] += own[at[i] : end]  # a document stands once in a list
            at[i] = end
            if end < len(docs):
                heapq.heapreplace(cursors, (int(docs[end]), i))
            else:
                heapq.heappop(cursors)
        found = np.flatnonzero(scores > (best[0][0] if len(best) == k else 0))
        if len(found) > k:
            least = np.partition(scores[found], -k)[-k]
            over, even = found[scores[found] > least], found[scores[found] == least]
            found = np.sort(np.concatenate([over, even[: k - len(over)]]))
        for x in found.tolist():
            entry = (int(scores[x]), -(low + x))
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return [(s, -d) for s, d in best]


def search(index: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the k best documents with a score above 0.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 75 + (25 n N) div L, and a score sums
    weight * ((10**9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included. Equal scores go by doc_id, documents
    without one last. Null, empty and termless items, and an empty index, give no rows; repeated item rows count once, and
    texts that share an item's id are ranked apart.
    """
    spark = index.sparkSession
    arrow_rows(spark)
    sums = index.where("term = ''").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = sums[0] or 0, sums[1] or 0
    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    blocks = max(1, -(-rows.count() // ITEMS))
    key = row_key("item_id", "text")
    terms = rows.select(key.alias("item"), "item_id", F.pmod(key, F.lit(blocks)).cast("int").alias("block"), F.explode(terms_of(F.col("text"))).alias("term"))
    terms = cut(terms.groupBy("block", "item", "item_id", "term").agg(F.count("*").alias("times")), "terms")
    found = cut(index.join(few(cut(terms.select("term").distinct(), "wanted")), "term").where("term <> ''").select("shard", "term", "n_docs", "data"), "found")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    weights = few(cut(found.groupBy("term").agg(F.sum("n_docs").alias("df")).select("term", weight.cast("long").alias("weight")), "weights"))
    asked = few(cut(terms.join(weights, "term").groupBy("block").agg(F.collect_list(F.struct("item", "term", (F.col("weight") * F.col("times")).alias("weight"))).alias("asked")), "asked"), 1000)
    postings = found.join(few(cut(terms.select("term", "block").distinct(), "blocks")), "term").select("shard", "block", "term", "data")
    pairs = cut(postings.select("shard", "block").distinct(), "pairs")
    lists = index.where("term = ''").join(few(pairs), "shard").select("shard", "block", "term", "data")

    def rank(found, asked):
        postings, listed = {}, b""
        for term, data in zip(found.column("term").to_pylist(), found.column("data").to_pylist(), strict=True):
            if term:
                postings[term] = data
            else:
                listed = data
        count = len(listed) // 17
        doc_id, n = np.frombuffer(listed, "<i8", count), np.frombuffer(listed, "<i8", count, 8 * count)
        known = np.frombuffer(listed, bool, count, 16 * count)
        m = 75 + (25 * n * n_docs) // max(n_terms, 1)
        own, each = {}, {}
        for group in asked.column("asked").to_pylist():
            for x in group:
                if x["term"] in postings:
                    each.setdefault(x["item"], []).append((x["term"], x["weight"]))
        for term in postings:
            pairs = from_varints(postings[term])
            docs, tf = np.cumsum(pairs[::2]), pairs[1::2]
            own[term] = docs, (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
        item, doc, score = [], [], []
        for x, of in each.items():
            best = best_of([(own[t][0], weight * own[t][1]) for t, weight in of], k)
            item += [x] * len(best)
            score += [s for s, _ in best]
            doc += [int(doc_id[d]) if known[d] else None for _, d in best]
        return pa.table({"item": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    both = postings.union(lists).groupBy("shard", "block").cogroup(pairs.join(asked, "block").groupBy("shard", "block"))
    best = both.applyInArrow(rank, "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = best.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(few(terms.select("item", "item_id").distinct()), "item").select("item_id", "rank", "doc_id", "score")


#: The same by SQL.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}') AS t FROM documents),
s AS (SELECT k, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM s),
p AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(t) AS term FROM d) GROUP BY k, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), c),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PATTERN}')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM i GROUP BY item_id, term),
r AS (SELECT q.item_id, s.doc_id, s.k, sum(q.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * s.n * c.n_docs) // c.n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN s ON s.k = p.k, c GROUP BY q.item_id, s.doc_id, s.k)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""
