"""Tokenizers: exact ids against the libraries, files, prefix counts, packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gridloom.llm import token_counts as tc
from gridloom.llm.encoders import Encoder
from gridloom.llm.packing import make_plan, pack_documents
from gridloom.llm.token_files import read_token_files, write_token_files

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = st.text(st.sampled_from(list("abcXYZ éÉñß中 \n\t.,!'#1²٣  ́Σσ▁<|>")) | st.characters(blacklist_categories=["Cs"]), max_size=60)


def ids(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_library(path):
    enc, tok = Encoder(path, 4), Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def same(text):
        assert np.frombuffer(enc.ids(text.encode()), "<u4").tolist() == ids(tok, text)

    same()

    @settings(max_examples=200, deadline=None)
    @given(st.lists(TEXTS | st.sampled_from(["a <|endoftext|> b", "", " "]), max_size=5))
    def same_together(texts):
        flat, at = enc.batch(pa.array([t.encode() for t in texts], pa.binary()))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [ids(tok, t) for t in texts]

    same_together()
    for text in ("don't we'll 'S x's", "<|endoftext|>a <|ENDOFTEXT|>", "a  b\n\n c \n", "word,word.word!", "\x1c a\x85b", ""):
        assert np.frombuffer(enc.ids(text.encode()), "<u4").tolist() == ids(tok, text)


def test_prefix_counts_are_the_library():
    own, sp = tc.PrefixCounter(PIECE, 50, 4), sentencepiece.SentencePieceProcessor(model_file=PIECE)

    @settings(max_examples=200, deadline=None)
    @given(TEXTS)
    def same(text):
        got = np.cumsum(own.deltas(text), dtype=np.int64).tolist()
        assert got == [len(sp.encode(text[:i])) for i in range(1, len(text) + 1)]

    same()

    @settings(max_examples=200, deadline=None)
    @given(st.lists(TEXTS, max_size=5))
    def same_together(texts):
        flat, at = own.batch(pa.array([t.encode() for t in texts], pa.binary()))
        assert [flat[a:b].sum() for a, b in zip(at, at[1:], strict=False)] == [len(sp.encode(t)) for t in texts]
        assert flat.tolist() == [x for t in texts for x in own.deltas(t).tolist()]

    same_together()


def test_prefix_questions(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = tc.prefix_counts(odd.where("doc_id in (1, 3, 10)"), PIECE)
    texts = {r.doc_id: r.text for r in odd.where("doc_id in (1, 3, 10)").collect()}
    for r in tc.tokens_of_prefix(rows, 7).collect():
        assert r.prefix_tokens == len(sp.encode(texts[r.doc_id][:7]))
    for r in tc.chars_within(rows, 5).collect():
        n = r.budget_chars
        assert len(sp.encode(texts[r.doc_id][:n])) <= 5 and all(len(sp.encode(texts[r.doc_id][:m])) > 5 for m in range(n + 1, len(texts[r.doc_id]) + 1))


def test_prefix_counts_edges(odd, none):
    got = tc.prefix_counts(odd, PIECE).collect()
    assert len(got) == odd.count() and all(r.n_tokens == 0 for r in got if r.n_bytes == 0)
    assert tc.prefix_counts(none, PIECE).count() == 0


def test_files_round_trip(spark, odd, none):
    tok = Tokenizer.from_file(WORD)
    folder = write_token_files(odd, WORD, 1)
    got = read_token_files(spark, folder, ids=True).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for g, (doc, text) in zip(got, rows, strict=True):
        want = [*ids(tok, text), 1]
        assert (g.doc_id, g.start, g.n_tokens, list(g.ids)) == (doc, start, len(want), want)
        assert g.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert read_token_files(spark, write_token_files(none, WORD, 1)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_places_each_piece_once(lengths):
    counts = np.bincount(lengths, minlength=25)
    plan = make_plan(counts, 24)
    seen = defaultdict(list)
    ends = np.append(np.flatnonzero(np.diff(plan.length)) + 1, len(plan.length))
    for i in range(len(plan.length)):
        last = i + 1 in ends
        upto = counts[plan.length[i]] if last else plan.rank[i + 1]
        for rank in range(plan.rank[i], upto):
            seen[plan.sequence[i] + rank - plan.rank[i]].append((plan.offset[i], plan.length[i]))
    assert sum(map(len, seen.values())) == len(lengths) and len(seen) == plan.sequences
    for slots in seen.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 24
    assert plan.sequences >= -(-sum(lengths) // 24)


def test_packing_edges(spark, odd, none):
    got = pack_documents(odd, BYTE, 2, 64).collect()
    tok = Tokenizer.from_file(BYTE)
    want = []
    for r in odd.collect():
        x = [*ids(tok, r.text or ""), 2]
        cuts = [0, *range(len(x) % 64 or 64, len(x) + 1, 64)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.length for r in got) == sum(len(ids(tok, r.text or "")) + 1 for r in odd.collect())
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for slots in by.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 64
    assert pack_documents(none, BYTE, 2, 64).count() == 0
