"""Token files and packing: against the tokenizers library, and exact round trips."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodegraph.llm import packing, token_coder
from lodegraph.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PLAIN = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
FAST = {p: Encoder(p, entries=50) for p in (BYTES, WORDS)}


def plain(path, text):
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=400, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0 　'’.,!?#$aAzZéÉΣσςİß0123éǅ<|>"))))
def test_chunks_give_the_ids_of_the_whole(path, text):
    assert FAST[path].ids(text) == packed(plain(path, text))


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("text", ["İstanbul", "in İstanbul, DİYARBAKIR.", "İ", "İ! Straße", "Şişli\nIĞDIR İzmir."])
def test_dotted_capital_i(path, text):
    assert FAST[path].ids(text) == packed(plain(path, text))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_of_documents(path, docs):
    for _, text in pairs_of(docs):
        assert FAST[path].ids(text) == packed(plain(path, text))


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_token_files(spark, request, name):
    table = request.getfixturevalue(name)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_coder.round_trip(spark, table, BYTES, 0).collect())
    at, want = 0, []
    for i, t in sorted(pairs_of(table), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*plain(BYTES, t), 0]
        want.append((at, i, len(ids), zlib.crc32(packed(ids))))
        at += len(ids)
    assert got == want


def test_files_hold_the_ids_themselves(spark, docs):
    blocks = token_coder.write_blocks(docs, BYTES, 0)
    parts = sorted((r.part, r.doc_no, r.lead * -1 if r.lead else 0, r.at, r.doc_id, bytes(r.ids)) for r in token_coder.read_blocks(blocks, with_ids=True).collect())
    by_doc = defaultdict(list)
    for _, _, _, at, doc, ids in parts:
        by_doc[doc].append((at, ids))
    assert {d: b"".join(x for _, x in sorted(v)) for d, v in by_doc.items()} == {i: packed([*plain(BYTES, t), 0]) for i, t in pairs_of(docs)}


def test_blocks_are_smaller_than_zlib_makes_them(spark):
    """Of whole blocks, with their headers, at zlib's best level on two-byte ids."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    blocks = token_coder.write_blocks(table, BYTES, 0, ranges=1)
    sizes = {r.block: len(r.payload) + len(r.alphabet) for r in blocks.filter(f"n = {token_coder.BLOCK_IDS}").collect()}
    ids = [r.ids for r in token_coder.read_blocks(blocks, with_ids=True).orderBy("at").collect()]
    whole, n = np.frombuffer(b"".join(ids), "<u4").astype("<u2"), token_coder.BLOCK_IDS
    plain_ = {b: len(zlib.compress(whole[b * n : (b + 1) * n].tobytes(), 9)) for b in sizes}
    assert len(sizes) > 50 and sum(sizes.values()) < 0.97 * sum(plain_.values())
    print("bits an id", 8 * sum(sizes.values()) / n / len(sizes), "zlib", 8 * sum(plain_.values()) / n / len(sizes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 65535), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), min_size=1, max_size=8))
def test_coder_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    found, codes = zip(*map(token_coder.alphabet, blocks))
    sizes = [len(f) for f in found]
    back = token_coder.decode_blocks(token_coder.encode_blocks(list(codes), sizes), [len(b) for b in blocks], sizes)
    heads = [token_coder.gaps_in(token_coder.gaps_out(f)) for f in found]
    assert all(np.array_equal(a, h[b]) for a, h, b in zip(blocks, heads, back))


def test_hot_id_spreads_over_ranges(spark):
    rows = [(7 if k % 3 else k, f"text {k} of {k * k}") for k in range(300)] + [(None, "a"), (None, "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = token_coder.range_cuts(table, 12)
    assert list(cuts) == sorted(cuts)
    blocks = token_coder.write_blocks(table, BYTES, 0, ranges=12)
    assert blocks.filter("array_contains(doc_ids, 7L)").select("part").distinct().count() > 3
    got = token_coder.document_ids(blocks).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(x := [*plain(BYTES, t), 0]), zlib.crc32(packed(x))) for i, t in rows)


def test_damaged_block_is_an_error(spark, docs):
    from pyspark.sql import functions as F

    blocks = token_coder.write_blocks(docs.limit(20), BYTES, 0)
    bad = blocks.withColumn("payload", F.expr("concat(x'00', substring(payload, 2))"))
    with pytest.raises(Exception, match="damaged"):
        token_coder.read_blocks(bad).collect()


def test_joined_checksums():
    rng = np.random.default_rng(1)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 50, 9)]
    assert token_coder.join_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def fewest(lengths, limit):
    """Best fit in order of length, document by document."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(limit - n)
    return len(gaps)


@pytest.mark.parametrize("name", ["docs", "edge", "none"])
def test_packing(spark, request, name):
    table = request.getfixturevalue(name)
    rows = packing.pack(spark, table, WORDS, 1, 4096).collect()
    want = []
    for i, t in pairs_of(table):
        ids = [*plain(WORDS, t), 1]
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(packed(ids[s : s + 4096]))) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= fewest([w[3] for w in want], 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), min_size=1, max_size=30))
def test_plan_places_every_piece_once(counts):
    seen, sequences = defaultdict(list), defaultdict(int)
    for length, low, high, each, first, _ in packing.plan(counts, 100, n_groups=6):
        seen[length].append((low, high))
        for rank in range(high - low):
            sequences[first + rank // each] += length
    for length, n in counts.items():
        at = 0
        for low, high in sorted(seen[length]):
            assert low == at
            at = high
        assert at == n
    assert max(sequences.values()) <= 100
    total = sum(k * n for k, n in counts.items())
    assert len(sequences) >= -(-total // 100)


def test_sequences_hold_the_ids(spark, docs):
    got = packing.sequences(spark, docs.limit(50), WORDS, 1, 4096).collect()
    assert sum(len(r.ids) for r in got) == sum(len(plain(WORDS, t)) + 1 for _, t in pairs_of(docs.limit(50)))
    assert all(len(r.ids) <= 4096 and r.ids[-1] in (1, *range(2, 49408)) for r in got)


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x85\xa0 　'’.,!?#$aAzZéÉΣσςİß0123éǅøù<|>"))), max_size=6))
def test_batches_give_the_ids_of_each_text(path, texts):
    got = FAST[path].many(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [plain(path, t) for t in texts]


@pytest.mark.parametrize("text", ["a \nb", "a\n b", "a\n\nb", " a", "\na", "a ", "a\n", "a \n", "a  b", "\n", "a\t \nb", "ñ.\nÑu,*** ab12", "<|endoftext|> a b", ""])
def test_white_space_at_the_ends_of_words(text):
    for _ in range(2):  # the second time from what was kept
        got = FAST[BYTES].many(pa.array([text, f"x {text} y", text + "\n" + text]))
        assert [x.tolist() for x in got] == [plain(BYTES, t) for t in (text, f"x {text} y", text + "\n" + text)]


def test_new_words_share_calls_of_the_model(docs):
    of, calls = Encoder(BYTES), []
    ask = of.pieces
    of.pieces = lambda letters: calls.append(1) or ask(letters)
    texts = [t or "" for _, t in pairs_of(docs)]
    got = of.many(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [plain(BYTES, t) for t in texts]
    assert len(calls) < len({w for t in texts for w in t.split()}) / 10


def test_steps_are_fewer_than_the_ids_of_a_block(monkeypatch):
    steps = []
    learn = token_coder.Model.learn
    monkeypatch.setattr(token_coder.Model, "learn", lambda self, x, hits: steps.append(len(x)) or learn(self, x, hits))
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, k, n).astype(np.uint16) for k, n in ((50, 4_000), (3_000, 4_000), (1, 7))]
    sizes = [50, 3_000, 1]
    coded = token_coder.encode_blocks(blocks, sizes)
    assert len(steps) <= 2 * 4_000 // 8
    assert all(np.array_equal(a, b) for a, b in zip(blocks, token_coder.decode_blocks(coded, [len(b) for b in blocks], sizes)))
    for b, s, p in zip(blocks, sizes, coded):  # a block's bytes don't depend on those coded beside it
        assert token_coder.encode_blocks([b], [s]) == [p]
