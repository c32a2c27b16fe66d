"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with the same set of shingles are one class (a row of the matrix). Columns that one class alone holds add nothing
to any product, and a row with too many of them for its size links with nothing: first a fixed quarter of the columns shows
that for most rows, then all columns of those that are left (counts: holders.py, exact). Shingles stand in one order for all,
rare ones first. The product's first block is each row's rarest columns, as many as its size allows to be missing and one:
there overlaps are accumulated for every pair, and pairs that can't reach the overlap that their sizes ask for go. What a row
has alone, and bitmaps of two rows (Sandes, Teodoro and Melo 2020), bound their overlap before that. For the pairs that stay,
the product is finished over their whole rows, exactly.

Components need no complete product. A first round multiplies only neighbours in each column, which joins up large groups of
near copies; the second takes every pair of a column whose rows the first left in different components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textkernel as tk
from .common import arrow_rows, chunks, components, cut, few, release, row_key, slices, tidy
from .holders import KIND, Chunks, bucketed, kept_bits, with_counts

#: Of so many columns one is looked at first. Parts into which columns of 255 rows or more are dealt for neighbours.
SAMPLE, PARTS = 4, 64
#: Bits of a row's parities.
BITS = 512
_MAPS = [f"m{i}" for i in range(BITS // 64)]


def _sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Distinct shingles of each text, ascending."""
    h, at = tk.shingles(tk.words(batch.column("text"), lower=True), n)
    return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def _class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 63-bit id of each set."""
    folded = np.array([np.bitwise_xor.reduce(tk.mix(s)) for s in sets], np.uint64)
    folded += np.array([len(s) for s in sets], np.uint64) * np.uint64(tk._P)
    return (tk.mix(folded) >> np.uint64(1)).astype(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def shingle_classes(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, doc_id, n_shingles and cid of every row: cid is the same for equal sets and null for empty ones."""

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                sets = _sets(batch, n)
                size = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), pa.array(size), pa.array(_class_ids(sets), mask=size == 0)], names=["k", "doc_id", "n_shingles", "cid"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "k long, doc_id long, n_shingles long, cid long")


def _needed(size, percent: int):
    """Least overlap with which a set of `size` links with any other."""
    return -(-size * percent // 100)


def incidence(texts: DataFrame, n: int, sample: int = 1) -> DataFrame:
    """A chunk table of the classes in texts (cid, text): whole sizes, and shingles, or those of one in `sample` columns."""

    def run(batches):
        out = Chunks()
        for whole in batches:
            for batch in chunks(whole, "text"):
                sets = _sets(batch, n)
                own = [s[s % np.uint64(sample) == 0] for s in sets] if sample > 1 else sets
                size = np.array([(len(s), len(o)) for s, o in zip(sets, own, strict=True)], np.int32).reshape(-1, 2)
                yield from out.add(np.asarray(batch.column("cid")), size, kept_bits(np.concatenate([*own, np.zeros(0, np.uint64)])))
        yield from out.row()

    return texts.mapInArrow(run, KIND)


def able(texts: DataFrame, n: int, percent: int, sample: int = SAMPLE) -> DataFrame:
    """cid of the classes of which the sampled columns don't rule out that they link."""

    def run(ids, sizes, x, shared):
        size, own = sizes.reshape(-1, 2).T
        lone = np.concatenate([[0], np.cumsum(shared == 0)])
        end = np.cumsum(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids[lone[end] - lone[end - own] <= size - _needed(size, percent)])], names=["cid"])

    table = bucketed(incidence(texts, n, sample), "sampled")
    out = cut(with_counts(table, run, "cid long", flags=True), "able")
    release(table)
    return out


def columns_of(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """key, cid, size, part, held: the shared ones among each class's first shingles in the common order, if it can link.

    And, with no key, one row a class: cid, size, held (shingles that others have too) and the parities of its shingles by
    hash: two sets' differ in no more bits than members.
    """
    kinds = ["key long", "cid long", "size int", "part int", "held int", *(f"{m} long" for m in _MAPS)]

    def run(ids, sizes, x, counts):
        out, rows, maps = [], [], []
        for cid, size, at in zip(ids.tolist(), sizes[::2].tolist(), np.cumsum(sizes[::2]) - sizes[::2], strict=True):
            c, own = counts[at : at + size], x[at : at + size]
            room = size - _needed(size, percent)
            lone = int((c < 2).sum())
            if lone <= room:
                first = np.lexsort((own, c))[lone : room + 1]
                key = own[first].astype(np.int64)
                part = np.where(c[first] == 255, (tk.mix(own[first] ^ np.uint64(cid % (1 << 64))) % np.uint64(PARTS)).astype(np.int64), 0)
                out.append((key, np.full(len(key), cid), np.full(len(key), size), part, np.full(len(key), size - lone)))
                rows.append((cid, size, size - lone))
                maps.append(np.packbits((np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8), bitorder="little").view("<i8"))
        if out:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            none = [pa.nulls(len(columns[0]), pa.int64())] * len(_MAPS)
            yield from slices(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)] + none, names=[k.split()[0] for k in kinds]))
            cid, size, held = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), cid, size, pa.nulls(len(rows), pa.int32()), held, *map(pa.array, np.stack(maps).T.copy())], names=[k.split()[0] for k in kinds])

    table = bucketed(incidence(texts, n), "incidence")
    out = cut(with_counts(table, run, ", ".join(kinds)), "columns")
    release(table)
    return out


def _overlap(a: str, b: str, percent: int) -> str:
    """Least overlap of sets of sizes a and b that link, in SQL: o / (a + b - o) >= percent / 100."""
    return f"((({a} + {b}) * {percent} + {100 + percent - 1}) div {100 + percent})"


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that link: the overlap is counted over both whole sets.

    texts: cid and text of one document per class; only those in pairs are shingled again.
    """
    need = few(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())

    def sets(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([s.tobytes() for s in _sets(batch, n)], pa.binary())], names=["cid", "s"])

    rows = texts.join(need, "cid").mapInArrow(sets, "cid long, s binary")

    def product(batches):
        for whole in batches:
            for batch in chunks(whole, "sa"):
                keep = []
                for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(rows.toDF("a", "sa"), "a").join(rows.toDF("b", "sb"), "b").mapInArrow(product, "a long, b long")


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs whose classes are in different components."""
    roots = cut(joined, "roots")
    return pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, doc_id, n_shingles, component_id, group of every row; k is row_key(id_col, text_col).

    Words are runs of bytes other than 09-0D and 20, A-Z lower-cased. Two rows link if 100 * overlap >= percent * union of
    their sets of n-word shingles (a shorter text: its whole sequence). component_id is the least doc_id that links reach.
    Null, empty or wordless texts have no shingles, no group, and their own doc_id as component_id. Repeated rows link, as
    equal sets do. A component's id is null only if all its ids are; `group` tells such components apart. Empty docs: no rows.
    """
    arrow_rows(docs.sparkSession)
    rows = cut(shingle_classes(docs, n, id_col, text_col), "classes")
    classes = cut(rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("k").alias("k")), "class")
    texts = _rows(docs, id_col, text_col).select("k", "text").join(few(classes.select("cid", "k")), "k").select("cid", "text")
    if not rows.groupBy("k").count().where("count > 1").isEmpty():  # repeated rows: one stands for all
        texts = texts.dropDuplicates(["cid"])
    left = able(texts, n, percent)
    texts = cut(texts.join(few(left), "cid"), "texts")  # seven plans read them
    release(left)
    tidy(docs.sparkSession)
    found = columns_of(texts, n, percent)
    columns, maps = found.where("key is not null").select("key", "cid", "size", "part", "held"), found.where("key is null").select("cid", "held", *_MAPS)
    # neighbors of about one size, in another order in each column: a group of near copies is joined by many random pairs; and
    # each row with the one of the column, and of its size, that has least alone: what links with any links with that most likely
    grade = F.floor(F.log(F.col("size").cast("double")) * 8)
    near = Window.partitionBy("key", "part").orderBy(grade, F.xxhash64("key", "cid"), "cid")
    least = Window.partitionBy("key", "part", grade).orderBy(F.col("size") - F.col("held"), "cid")
    met = columns.select("cid", "size", F.array(F.lag(F.struct("cid", "size")).over(near), F.first(F.struct("cid", "size")).over(least)).alias("others"))
    first = met.select("cid", "size", F.explode("others").alias("o")).where(f"o is not null AND o.cid <> cid AND 100 * least(size, o.size) >= {percent} * greatest(size, o.size)")
    first = cut(first.select(F.least("cid", "o.cid").alias("a"), F.greatest("cid", "o.cid").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    # of each row the pair of most common columns first; then the pairs that these haven't joined
    best = cut(first.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "best")
    links = cut(verified(best, texts, n, percent), "links")
    more = apart(first.select("a", "b").join(best, ["a", "b"], "left_anti"), components(links))
    links = cut(links.union(verified(cut(more, "pairs"), texts, n, percent)), "links")
    joined = components(links)
    parts = columns.join(joined.toDF("cid", "root"), "cid", "left").select("key", "cid", "size", F.coalesce("root", "cid").alias("root"))
    mixed = parts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    parts = cut(parts.join(mixed, "key").join(maps, "cid"), "mixed")
    x, y = (parts.select("key", F.col("root").alias(f"r{x}"), F.col("cid").alias(x), F.col("size").alias(f"s{x}"), F.col("held").alias(f"h{x}"), *(F.col(m).alias(x + m) for m in _MAPS)) for x in "ab")
    # overlaps accumulated over the block of rare columns; beyond it, the row that leaves the block first has `need` - 1 others
    need = lambda s: f"(({s} * {percent} + 99) div 100)"
    least = _overlap("sa", "sb", percent)
    alike = " + ".join(f"bit_count(a{m} ^ b{m})" for m in _MAPS) + f" <= sa + sb - 2 * {least}"
    block = x.join(y, (x.key == y.key) & F.expr(f"ra <> rb AND a < b AND 100 * least(sa, sb) >= {percent} * greatest(sa, sb) AND least(ha, hb) >= {least} AND {alike}"))
    rest = block.groupBy("a", "b", "sa", "sb").agg(F.count("*").alias("n")).where(f"n + greatest({need('sa')}, {need('sb')}) - 1 >= {least}")
    rest = cut(rest.select("a", "b").join(first.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    links = links.union(verified(rest, texts, n, percent))
    joined = components(links)
    release(texts, found, first, best, parts, rest)
    tidy(docs.sparkSession)
    named = classes.select("cid", "least").join(joined.toDF("cid", "root"), "cid", "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    named = cut(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root").select("cid", "root", "component_id")
    return rows.join(ids, "cid", "left").select("k", "doc_id", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("root").alias("group"))
