"""Exact token ids of whole texts with a library's tokenizer, by way of a bounded table of units.

A text is cut where the tokenizer's own pre-tokenisation always cuts (before white space that follows something else), so
the ids of the units, put together, are the ids of the text. Texts for which that isn't certain go to the library whole.
Units of a whole chunk of texts are looked up at once by their 64-bit hashes; only units not met before are worked out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from . import textkernel as tk

#: Longer parts are not remembered.
LONG_UNIT = 256
#: Slots of a unit table as a power of two; half of them are used before it begins anew. Units looked up at once.
TABLE_BITS, SLICE = 20, 1 << 18
#: Units that are encoded as one text.
JOINT = 1000
_SPACES = frozenset(b" \t\n\r\x0b\x0c")
#: Where texts are cut into units: before white space (and after, where that is dropped), and between letter and punctuation.
_LETTER, _MARK = (np.array([chr(b).isalpha() and b < 0x80 for b in range(256)]), np.array([0x20 < b < 0x7F and not chr(b).isalnum() for b in range(256)]))
_CUTS = {kind: (tk.SPACE_WORD[:, None] & ~tk.SPACE_WORD[None]) | (_LETTER[:, None] & _MARK[None]) | ((kind == "folded") & ~tk.SPACE_WORD[:, None] & tk.SPACE_WORD[None]) for kind in ("spaced", "folded")}
#: White space other than ASCII's.
_ODD_SPACE = re.compile("[\x85\xa0  -     　]")


class Memo(dict):
    """A bounded memo: when full it becomes the old one, whose entries come back as they are asked for again.

    So the units that come up often are never worked out twice. `make(unit)` gives a new unit's value.
    """

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, unit):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        v = self.old[unit] if unit in self.old else self.make(unit)
        if len(unit) <= LONG_UNIT:
            self[unit] = v
        return v


class UnitTable:
    """Values of units by their 64-bit hash: an open hash table of numpy arrays, so that lookups need no Python objects.

    make(units' bytes, their hashes) gives each new unit's values as bytes of `dtype`, or None. The table holds half of its
    slots in units and then begins anew; a slice of units with more new ones than that makes it larger.
    """

    def __init__(self, make, dtype: str, bits: int = TABLE_BITS):
        self.make, self.dtype, self.bits = make, np.dtype(dtype), bits
        self.begin()

    def begin(self) -> None:
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.start = np.zeros(1 << self.bits, np.int64)
        self.size = np.full(1 << self.bits, -2, np.int32)  # -2: free, -1: its value is None
        self.pool, self.used, self.units = np.zeros(1 << 16, self.dtype), 0, 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or the free one where it would go."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        far = np.flatnonzero((self.key[at] != h) & (self.size[at] != -2))
        while len(far):
            at[far] = (at[far] + 1) & ((1 << self.bits) - 1)
            far = far[(self.key[at[far]] != h[far]) & (self.size[at[far]] != -2)]
        return at

    def _add(self, h: np.ndarray, made: list[bytes | None]) -> None:
        """Puts different new hashes and their values in."""
        x = np.frombuffer(b"".join(v for v in made if v), self.dtype)
        size = np.array([-1 if v is None else len(v) // self.dtype.itemsize for v in made])
        start = self.used + np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        while self.used + len(x) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(x)] = x
        self.used += len(x)
        self.units += len(h)
        while len(h):
            at, one = np.unique(self._slots(h), return_index=True)  # one for each free slot; the others look on
            self.key[at], self.start[at], self.size[at] = h[one], start[one], size[one]
            left = np.ones(len(h), bool)
            left[one] = False
            h, start, size = h[left], start[left], size[left]

    def values(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of values of each unit (-1: None), and all values in order."""
        sizes, flat = [], []
        for a in range(0, len(h), SLICE):
            own = h[a : a + SLICE]
            at = self._slots(own)
            new = np.flatnonzero(self.size[at] == -2)
            if len(new):
                new = new[np.unique(own[new], return_index=True)[1]]
                if self.units + len(new) > 1 << (self.bits - 1):
                    new = np.unique(own, return_index=True)[1]
                    while len(new) > 1 << (self.bits - 1):
                        self.bits += 1
                    self.begin()
                self._add(own[new], list(self.make([data[start[a + i] : end[a + i]].tobytes() for i in new.tolist()], own[new].tolist())))
                at = self._slots(own)
            size = self.size[at]
            n = np.maximum(size, 0).astype(np.int64)
            before = np.cumsum(n) - n
            flat.append(self.pool[np.repeat(self.start[at] - before, n) + np.arange(int(n.sum()))])
            sizes.append(size)
        if not sizes:
            return np.zeros(0, np.int32), np.zeros(0, self.dtype)
        return np.concatenate(sizes), np.concatenate(flat)


def holding(data: np.ndarray, at: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Which of the texts that begin at `at` in data hold one of the marks."""
    out, whole = np.zeros(len(at) - 1, bool), data.tobytes()
    for m in marks:
        i = whole.find(m)
        while i >= 0:
            k = int(np.searchsorted(at, i, "right")) - 1
            if i + len(m) <= at[k + 1]:
                out[k] = True
            i = whole.find(m, i + 1)
    return out


def per_text(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of sizes over each text's units, which begin at `first`."""
    run = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def replaced(flat: np.ndarray, counts: np.ndarray, other: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """flat and the places where texts begin in it, with the values of some texts replaced."""
    at = np.concatenate([[0], np.cumsum(counts)])
    if other:
        parts, last = [], 0
        for i, x in sorted(other.items()):
            parts += [flat[at[last] : at[i]], x]
            last = i + 1
        flat = np.concatenate([*parts, flat[at[last] :]])
        counts = counts.copy()
        for i, x in other.items():
            counts[i] = len(x)
        at = np.concatenate([[0], np.cumsum(counts)])
    return flat, at


class Encoder:
    """Ids of texts (UTF-8 bytes) as the tokenizers library gives them.

    kind "spaced": byte-level BPE whose pre-tokens may begin with white space. kind "folded": white space parts words and
    is dropped, and A-Z are lower-cased. Any other: each text goes to the library.
    """

    def __init__(self, path: str, bits: int = TABLE_BITS):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        self.kind = ""
        if pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and norm is None:
            self.kind = "spaced"
        elif steps == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" and "\\s" in pre["pretokenizers"][0]["pattern"].get("Regex", ""):
            self.kind = "folded"
        self.marks = [x["content"].encode() for x in spec["added_tokens"]]
        self.table = UnitTable(lambda units, _: self.of_units(units), "<u4", bits)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def of(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_units(self, units: list[bytes]) -> list[bytes | None]:
        """Each unit's ids, or None: only whole texts will do. Most units are encoded as one text, in which they stay apart."""
        out: list[bytes | None] = [None] * len(units)
        joint, at, size = [], [], []
        for i, unit in enumerate(units):
            text = unit.decode()
            if self.kind == "spaced" and _ODD_SPACE.search(text):
                continue
            if unit[-1] in _SPACES:
                out[i] = self.of(text)
                continue
            if self.kind == "folded" or unit[0] not in _SPACES:
                text = "\n" + text
            joint.append(text)
            at.append(i)
            size.append(len(text))
        for k in range(0, len(joint), JOINT):
            got = self.tokenizer.encode("".join(joint[k : k + JOINT]), add_special_tokens=False)
            ids, ends = np.array(got.ids, "<u4"), np.cumsum(size[k : k + JOINT])
            place = np.array([x[0] for x in got.offsets], np.int64)
            if self.kind == "spaced":  # of the line breaks put before units: an id each
                marks = np.array([x[0] == "\n" and units[i][0] not in _SPACES for x, i in zip(joint[k : k + JOINT], at[k : k + JOINT], strict=True)])
            first = np.searchsorted(place, np.append(0, ends))
            for j, i in enumerate(at[k : k + JOINT]):
                out[i] = ids[first[j] + (1 if self.kind == "spaced" and marks[j] else 0) : first[j + 1]].tobytes()
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a binary column one after another, and for n texts n + 1 places in them; null: no ids."""
        if not self.kind:
            return replaced(np.zeros(0, "<u4"), np.zeros(len(texts), np.int64), {i: np.frombuffer(self.of((t.as_py() or b"").decode()), "<u4") for i, t in enumerate(texts)})
        data, at = tk.column_bytes(texts)
        if self.kind == "folded":
            data = tk.LOWER[data]
        start, end, first = tk.units(data, at, _CUTS[self.kind])
        if self.kind == "folded":
            held = tk.SPACE_WORD[data[start]]
            first = np.concatenate([[0], np.cumsum(held)])[first]
            start, end = start[held], end[held]
        hashes = tk.hash_spans(tk.running_sums(data), start, end)
        sizes, flat = self.table.values(hashes, data, start, end)
        whole = holding(data, at, self.marks) | (per_text(sizes < 0, first) > 0)
        return replaced(flat, per_text(np.maximum(sizes, 0), first), {i: np.frombuffer(self.of(texts[i].as_py().decode()), "<u4") for i in np.flatnonzero(whole).tolist()})

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """batch(texts) with end_id after each text."""
        flat, at = self.batch(texts)
        return np.insert(flat, at[1:], end_id), at + np.arange(len(at))

    def ids(self, text: bytes) -> bytes:
        return self.batch(pa.array([text], pa.binary()))[0].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a tokenizer file; it stays for later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
