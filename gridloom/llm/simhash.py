"""SimHash near-dedup by anchor-point covering: fingerprints meet at the anchors of a covering code that are near them.

A text's fingerprint has a bit for each of the 64 of its shingles' hashes, set if more than half of the shingles set it. The
anchors, for each half of 32 bits, are a perfect code: Hamming's (31, 26) beside one free bit, 2**27 words, of which one lies
within 1 of any half. Fingerprints that differ by 4 bits or fewer differ by 2 or fewer in one half; a word between the two
differs by 1 or less from both, so its anchor is within 1 + 1 of both. Each fingerprint therefore goes to every anchor within
covering radius and (its share of the) threshold, 17 a half, and only those of one anchor are compared: exact, as no pair can
miss, and selective, as an anchor sees 17 in 2**27.

An anchor's fingerprints give a spanning forest of links, never all pairs. One with more than PART of them is dealt into
parts, and each two parts are compared by a task of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import arrow_rows, chunks, components, cut, few, release, slices

#: Most differing bits of a link, and what the two halves can share of it.
DISTANCE = 4
#: Shingles hashed at once; fingerprints of an anchor that are compared at once; rows of one fingerprint that are told apart.
SLICE, PART, HOT_ROWS = 1 << 16, 2048, 10_000
SEED = 42
#: Least runs that are linked by search rather than pair by pair.
SMALL = 6


def _shingle_bytes(w: tk.Words, n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts joined by single spaces, and start, end and text of every shingle there, repeats included."""
    size = w.end - w.start
    end = np.cumsum(size + 1) - 1
    joined = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[end] = False
    joined[inside] = w.data[tk.SPACE_WORD[w.data]]
    counts = w.counts()
    text = w.text_of_word()
    left = w.first[1:][text] - np.arange(len(text))  # words from here to the text's end
    begins = np.flatnonzero((left >= n) | ((counts[text] < n) & (left == counts[text])))
    last = begins + np.minimum(n, counts[text[begins]]) - 1
    return joined.tobytes(), (end - size)[begins], end[last], text[begins]


def fingerprints(col: pa.Array, n: int = 4) -> np.ndarray:
    """The 64-bit fingerprint of each text; zero where there are no words."""
    w = tk.words(col, lower=True)
    texts = len(w.first) - 1
    joined, start, end, text = _shingle_bytes(w, n)
    ones, digest = np.zeros((texts, 64), np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(start), SLICE):
        own = text[at : at + SLICE]
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(start[at : at + SLICE].tolist(), end[at : at + SLICE].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    total = np.bincount(text, minlength=texts)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _syndromes() -> np.ndarray:
    """For each of the four bytes of a half, the exclusive or of the places (from 1) of its set bits; the last bit has none."""
    place = np.append(np.arange(1, 32), 0)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool)
    return np.stack([np.bitwise_xor.reduce(np.where(bits, place[8 * i : 8 * i + 8], 0), axis=1) for i in range(4)])


_SYNDROME = _syndromes()
#: Of each syndrome but 0 the 15 pairs of bits whose flip gives a code word, as masks.
_PAIRS = np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if 0 < i ^ s and i < i ^ s] for s in range(1, 32)], np.uint32)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in fp and keys of the anchors within radius and threshold: 17 for each half, 2 for a half that is one itself."""
    places, keys = [], []
    for half in (0, 1):
        y = (fp >> np.uint64(32 * half)).astype(np.uint32)
        s = np.bitwise_xor.reduce(_SYNDROME[np.arange(4)[:, None], y.view(np.uint8).reshape(-1, 4).T], axis=0)
        home = y ^ np.where(s > 0, np.uint32(1) << np.maximum(s - 1, 0).astype(np.uint32), np.uint32(0))
        off = np.flatnonzero(s)
        at = np.concatenate([np.arange(len(y)), np.arange(len(y)), np.repeat(off, _PAIRS.shape[1])])
        word = np.concatenate([home, home ^ np.uint32(1 << 31), (y[off, None] ^ _PAIRS[s[off] - 1]).ravel()])
        places.append(at)
        keys.append(word.astype(np.int64) | (half << 32))
    return np.concatenate(places), np.concatenate(keys)


def _forest(fp: np.ndarray, limit: int) -> tuple[list, list]:
    """Links that join up whatever differs by `limit` or fewer bits, one less than a component has members."""
    a, b = [], []
    left = np.arange(len(fp))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        root = fp[front[0]]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                near |= (np.bitwise_count(fp[front[i : i + 256], None] ^ fp[left]) <= limit).any(0)
            front, left = left[near], left[~near]
            a.append(np.full(len(front), root))
            b.append(fp[front])
    return a, b


def _links(key: np.ndarray, fp: np.ndarray, limit: int) -> pa.RecordBatch:
    """Links within each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    a, b = [fp[:0]], [fp[:0]]
    small = np.repeat(size, size) <= SMALL
    for step in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= limit]
        a.append(fp[i])
        b.append(fp[i + step])
    for run in np.flatnonzero(size > SMALL):
        more = _forest(fp[first[run] : first[run] + size[run]], limit)
        a += more[0]
        b += more[1]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])


def near_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links that join up all fingerprints (distinct longs, column fp) that differ by `distance` (4 at most) or fewer bits."""
    if distance > DISTANCE:
        raise ValueError(f"these anchors find pairs of up to {DISTANCE} bits")

    def place(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            at, key = anchors(fp.view(np.uint64))
            yield from slices(pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], names=["key", "fp"]))

    def compare(batches):
        key, part, fp = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:  # sorted; a run may go on in the next batch
            new = [np.asarray(batch.column(c)) for c in ("key", "part", "fp")]
            whole = [np.concatenate(x) for x in zip((key, part, fp), new, strict=True)]
            other = np.flatnonzero((whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1]))
            end = int(other[-1]) + 1 if len(other) else 0
            key, part, fp = (x[end:] for x in whole)
            run = np.cumsum(np.concatenate([[0], (whole[0][1:end] != whole[0][: end - 1]) | (whole[1][1:end] != whole[1][: end - 1])])) if end else np.zeros(0, np.int64)
            yield from slices(_links(run, whole[2][:end].view(np.uint64), distance))
        yield from slices(_links(np.zeros(len(fp), np.int64), fp.view(np.uint64), distance))

    near = prints.select("fp").mapInArrow(place, "key long, fp long")
    hot = cut(near.groupBy("key").count().where(f"count > {PART}").select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "hot")
    # part p of an anchor's fingerprints meets every other one, q, in the task of (p, q)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long")
    each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(own, q.cast("long")) * (1 << 31) + F.greatest(own, q.cast("long")))
    dealt = near.join(few(hot), "key", "left").select("key", "fp", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(each)).alias("part"))
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, n: int = 4, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs.

    Words are runs of bytes other than 09-0D and 20, A-Z lower-cased; shingles are n words joined by single spaces, repeats
    included (a shorter text: its whole sequence). Fingerprints link at `distance` or fewer differing bits, and component_id is
    the least doc_id that links reach. Null, empty or wordless texts have the fingerprint zero, which links like any other.
    Repeated rows and equal fingerprints are of one component. Rows without an id get their component's, null if no row of it
    has one. Empty docs: no rows. Other columns aren't read.
    """
    arrow_rows(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in chunks(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), n).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = cut(rows.mapInArrow(run, "doc_id long, fp long"), "prints")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")), "distinct")
    links = cut(near_links(prints, distance).distinct(), "links")
    joined = cut(components(links).toDF("fp", "root"), "joined")
    release(links)
    named = prints.join(few(joined), "fp")
    named = cut(named.join(few(named.groupBy("root").agg(F.min("least").alias("component"))), "root").select("fp", "component"), "named")
    prints = prints.join(few(named), "fp", "left").select("fp", "n_rows", F.coalesce("component", "least").alias("component_id"))
    prints = cut(prints, "components")
    # fingerprints of very many rows are few (at most one in HOT_ROWS rows), so these rows needn't meet at their key
    often, rest = few(cut(prints.where(f"n_rows > {HOT_ROWS}"), "often")), few(prints.where(f"n_rows <= {HOT_ROWS}"))
    out = rows.join(often, "fp").unionByName(rows.join(often.select("fp"), "fp", "left_anti").join(rest, "fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
