"""Exact token counts at every prefix of a text, by dynamic programming over the pieces of a sentencepiece BPE model.

A sequence of pieces is what the model gives for their text exactly if each neighbouring pair is what it gives for the
pair's text. So the last piece at every place follows from the last pieces at earlier places: of the pieces that end
there, it is the one that goes with the last piece where it begins. One pass over a text gives the count at each prefix;
later questions (how many tokens in the first n characters, how many characters within a budget) read the stored counts.

No piece holds certain neighbouring characters (a white space mark after anything else, mostly a letter before punctuation),
so texts fall apart there into units whose counts are computed once and remembered; a text's counts are its units' counts
one after another. The units of a whole chunk of texts are looked up at once.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkernel as tk
from .common import arrow_rows, chunks, free_name
from .encoders import TABLE_BITS, Memo, UnitTable, holding, per_text, replaced

#: Parts of units, and as many pairs of pieces, that a Python worker's memos hold, twice.
MEMO_UNITS = 150_000
SPACE = "▁"
_FIRST = np.uint64(0x5851F42D4C957F2D)


class PrefixCounter:
    """deltas(text): for each character the tokens by which the prefix that it ends has more than the one before.

    The first character's delta holds the mark that the model puts before a text, so an empty text has 0 tokens.
    """

    def __init__(self, path: str, limit: int = MEMO_UNITS, bits: int = TABLE_BITS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        pieces = range(m.get_piece_size())
        self.score = {m.id_to_piece(i): m.get_score(i) for i in pieces if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.longest = max(map(len, self.score))
        self.units = Memo(self.parts, limit)
        self.pairs = Memo(lambda p: self.merge(p[0] + p[1]) == [*p], limit)
        self.whole: dict[str, bool] = {}
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        lengths: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}  #: of pieces by their last three characters
        # what the cutting into units rests on
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.lines_apart = not any("\n" in p for p in self.score)
        probe = "ﬁ½Ａ é x  y "
        self.plain = m.decode(m.encode(probe)) == probe and m.encode("a", out_type=str)[0].startswith(SPACE)
        # bytes between which no piece goes on: ASCII ones, and a space after or a line's end beside any
        mark = lambda b: SPACE if b == 0x20 else chr(b)
        self.seams = np.array([[mark(a) + mark(b) not in self.inside if max(a, b) < 0x80 else (b == 0x20 and self.apart) or (0x0A in (a, b) and self.lines_apart) for b in range(256)] for a in range(256)])
        self.heads: set[int] = set()
        self.table = UnitTable(lambda units, keys: map(self.of_unit, units, keys), "<i1", bits)
        lines = "\\n|" if self.lines_apart else ""
        self.cut = re.compile(f"{lines}{SPACE}*[^{SPACE}{lines[:2]}]+|{SPACE}+")

    def merge(self, text: str) -> list[str]:
        """Pieces by the model's rule: again and again the pair of neighbours whose joint piece scores highest, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def real(self, piece: str) -> bool:
        """A piece that its own text gives."""
        got = self.whole.get(piece)
        if got is None:
            got = self.whole[piece] = self.merge(piece) == [piece]
        return got

    def unit(self, unit: str) -> bytes:
        """Deltas of one unit, as signed bytes."""
        last, count, out = [""], [0], array("b")
        score, pairs = self.score, self.pairs
        for end in range(1, len(unit) + 1):
            for n in (*self.lengths.get(unit[max(0, end - 3) : end], ()), 2):
                start = end - n
                if start < 0 or (piece := unit[start:end]) not in score or not self.real(piece):
                    continue
                if not start or pairs[last[start], piece]:
                    last.append(piece)
                    count.append(count[start] + 1)
                    break
            else:
                piece = unit[end - 1]
                last.append(piece)
                # not in the vocabulary: its bytes, and it merges with nothing
                count.append(count[end - 1] + (1 if piece in score else len(piece.encode())))
            out.append(count[end] - count[end - 1])
        return out.tobytes()

    def parts(self, unit: str) -> bytes:
        """Deltas of a unit by way of the parts that it falls into."""
        seams = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.inside), len(unit)]
        if len(seams) == 2:
            return self.unit(unit)
        return b"".join(self.units[unit[a:b]] for a, b in zip(seams, seams[1:], strict=False))

    def check(self) -> None:
        if not (self.plain and self.apart):
            raise ValueError("this model folds text or joins pieces over white space; its prefixes have no unit form")

    def deltas(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int8)
        self.check()
        got = np.frombuffer(b"".join(map(self.units.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE)))), np.int8)
        out = got[1:].copy()
        out[0] += got[0]
        return out

    def of_unit(self, unit: bytes, key: int) -> bytes:
        """Deltas of a unit; one that begins a text holds the mark before it."""
        if key in self.heads:
            return self.deltas(unit.decode()).tobytes()
        return b"".join(map(self.parts, self.cut.findall(unit.decode().replace(" ", SPACE))))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Deltas of all texts of a binary column one after another, and for n texts n + 1 places in them; null: none."""
        self.check()
        data, at = tk.column_bytes(texts)
        start, end, first = tk.units(data, at, self.seams)
        h = tk.hash_spans(tk.running_sums(data), start, end)
        head = first[:-1][np.diff(first) > 0]
        h[head] ^= _FIRST
        self.heads = set(h[head].tolist())
        sizes, flat = self.table.values(h, data, start, end)
        other = {i: self.deltas(texts[i].as_py().decode()) for i in np.flatnonzero(holding(data, at, [SPACE.encode()])).tolist()}
        return replaced(flat, per_text(sizes, first), other)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefix_deltas (a signed byte per character) of every whole text.

    A null text is empty: 0 bytes, 0 tokens, no deltas. Rows stay rows: repeated and null ids keep their own. n_tokens is
    the count at the longest prefix. Special strings inside texts are ordinary text, as the library has it.
    """
    arrow_rows(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("prefix_deltas", pa.binary())])

    def count(batches):
        own = counter(model_path)
        for whole in batches:
            for batch in chunks(whole, "text"):
                flat, at = own.batch(batch.column("text"))
                run = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
                kept = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype("<i4").tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(tk.column_bytes(batch.column("text"))[1])), pa.array(run[at[1:]] - run[at[:-1]]), kept], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary")


def _ask(counts: DataFrame, name: str, answer, number) -> DataFrame:
    """counts with a column of answer(counts at each prefix of 1, 2, .. characters, number); number: a column or a value."""
    kept, n_col = counts.schema, free_name(counts, "_n")

    def run(batches):
        for batch in batches:
            got = [answer(np.cumsum(np.frombuffer(d or b"", np.int8), dtype=np.int64), n) for d, n in zip(batch.column("prefix_deltas").to_pylist(), batch.column(n_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns([n_col]).columns, pa.array(got, pa.int64())], names=[*kept.names, name])

    return counts.withColumn(n_col, (number if not isinstance(number, int) else F.lit(number)).cast("long")).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + f", {name} long")


def tokens_of_prefix(counts: DataFrame, chars) -> DataFrame:
    """Adds prefix_tokens: tokens of the text's first `chars` characters, from the stored counts."""
    return _ask(counts, "prefix_tokens", lambda c, n: int(c[min(n, len(c)) - 1]) if n and n > 0 and len(c) else 0, chars)


def chars_within(counts: DataFrame, budget) -> DataFrame:
    """Adds budget_chars: characters of the longest prefix of at most `budget` tokens, from the stored counts."""
    return _ask(counts, "budget_chars", lambda c, n: int(fit[-1]) + 1 if n is not None and len(fit := np.flatnonzero(c <= n)) else 0, budget)
