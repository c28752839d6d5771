import hashlib
import random
import re
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aestudy.llm import bpe_stream, pattern_packing, token_files
from aestudy.llm.tokens import BYTE_LEVEL_PATTERN, encoder, has_long_run
from aestudy.sources.checkpoints import scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [t or "" for _, t in cases.texts()] + [" \n x", "a  b\n\n c \n", "\t\ta's 12 3..  ", "é áb ́x", "it's I'LL", "4½Ⅷ", "ǅ ﬁ ẞ İ ΟΔΟΣ", "नमस्ते", "ab\x00c​d", "thethe" * 900, "y" * 2000 + " " * 3000]


def library(path):
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def ids_of(own, text):
    return own.encode(text, add_special_tokens=False).ids


def test_byte_ids_equal_the_library():
    assert public_tokenizers.PATTERN == BYTE_LEVEL_PATTERN
    own, fast = library(BYTE), encoder(BYTE)
    for text in ODD:
        assert fast.encode(text.encode()).tolist() == ids_of(own, text), text[:40]


def test_long_runs_are_those_of_the_pattern():
    pattern = re.compile(rb"\S{1000}|\s{1000}")
    for size in (0, 1, 998, 999, 1000, 1001):
        for run in (b"a" * size, b" " * size, b"\t\v" * (size // 2), "é".encode() * (size // 2), b"\x1c\xa0" * (size // 2)):
            for text in (run, b"x " + run, run + b" y", b"x" + run + b"y", b"ab " * 500 + run, run + b"\nab" * 500):
                assert has_long_run(text) == bool(pattern.search(text)), (size, text[:9])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text_encodes_as_the_library_does(text):
    assert encoder(BYTE).encode(text.encode()).tolist() == ids_of(library(BYTE), text)


def test_stream_ids_and_text_equal_the_library():
    own, stream = library(WORD), bpe_stream.stream_tokenizer(WORD)
    for text in ODD:
        ids = np.frombuffer(stream.encode(text.encode()), dtype="<u4").tolist()
        assert ids == ids_of(own, text), text[:40]
        joiner = bpe_stream.TokenJoiner(stream)
        parts = b"".join(joiner.feed(ids[i : i + 3]) for i in range(0, len(ids), 3))
        assert parts.decode() == own.decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="inghtersaou", min_size=1, max_size=3000), st.integers(1, 700))
def test_tokens_are_final_when_they_are_emitted(word, step):
    stream = bpe_stream.stream_tokenizer(WORD)
    whole = np.frombuffer(stream.word(word), dtype="<u4").tolist()
    transducer, out = stream.words, []
    for at in range(0, len(word), step):
        out += transducer.feed(word[at : at + step])
        assert out == whole[: len(out)]
        assert len(transducer.buffer) < bpe_stream.WINDOW + stream.ahead + max(map(len, stream.vocab))
    assert out + list(transducer.finish()) == whole


def test_lookahead_of_a_small_merge_list():
    merges = [("a", "b"), ("c", "ab"), ("d", "c"), ("x", "y")]
    # d+c depends on c+ab, which depends on what follows: 1 + 1 letters, and a+b one more.
    assert bpe_stream.lookahead(merges, "") == 3
    assert bpe_stream.lookahead([], "") == 0


def test_byte_decoder_waits_for_whole_characters():
    stream = bpe_stream.stream_tokenizer(WORD)
    ids = np.frombuffer(stream.encode("été 日本 naïve".encode()), dtype="<u4").tolist()
    decoder = bpe_stream.ByteDecoder(stream)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], last=True) == "été 日本 naïve "


def test_encode_texts(spark):
    own = library(WORD)
    expected = []
    for i, t in cases.texts():
        ids = ids_of(own, t or "")
        decoded = own.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    found = bpe_stream.encode_texts(cases.frame(spark), WORD, digests=True).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    real = {r["doc_id"]: r for r in bpe_stream.encode_texts(cases.frame(spark), WORD).collect()}
    assert real[16]["ids"] == ids_of(own, "one two three") and real[16]["decoded"] == "one</w> two</w> three</w>"
    assert bpe_stream.encode_texts(cases.empty(spark), WORD).collect() == []


def test_pieces_and_packing(spark):
    own = library(BYTE)
    pieces = pattern_packing.cut_pieces(cases.frame(spark), BYTE, end_id=2, most=128)
    packed = pattern_packing.pack(pieces, most=128).collect()
    expected = []
    for i, t in cases.texts():
        ids = ids_of(own, t or "") + [2]
        first = (len(ids) - 1) % 128 + 1
        edges = [0, *range(first, len(ids) + 1, 128)]
        expected += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in packed)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends <= 128
    total = sum(r["length"] for r in packed)
    assert len(by_sequence) <= -(-total // 128) + 2
    whole = pattern_packing.sequences(pattern_packing.pack(pieces, most=128)).collect()
    assert sum(len(r["ids"]) for r in whole) == total
    assert pattern_packing.pack(pattern_packing.cut_pieces(cases.empty(spark), BYTE)).collect() == []
    with pytest.raises(ValueError):
        pattern_packing.cut_pieces(cases.empty(spark), BYTE, most=0)


def test_plan_uses_up_the_histogram():
    rng = random.Random(4)
    for most in (16, 100):
        histogram = np.array([0] + [rng.choice([0, 0, 1, 7, 300]) for _ in range(most)])
        plan = pattern_packing.plan_patterns(histogram)
        used = np.zeros_like(histogram)
        for lengths, count in plan:
            assert 0 < sum(lengths) <= most and count > 0
            for v in lengths:
                used[v] += count
        assert (used == histogram).all()
        assert sum(c for _, c in plan) <= sum(c for _, c in pattern_packing.pack_left_over(histogram))


def test_full_patterns_are_all_of_them():
    lengths = np.array([1, 2, 3, 5, 8, 10])
    found = {tuple(sorted(v for v in p if v)) for p in pattern_packing.full_patterns(lengths, 10).tolist()}
    own = lengths.tolist()
    expected = {(a,) for a in own if a == 10} | {tuple(sorted((a, b))) for a in own for b in own if a + b == 10}
    expected |= {tuple(sorted((a, b, c))) for a in own for b in own for c in own if a + b + c == 10}
    assert found == expected


def test_token_files_round_trip(spark):
    own = library(BYTE)
    rows = sorted(((i is not None, i or 0, t or "", i) for i, t in cases.texts()), key=lambda r: r[:3])
    expected, start = [], 0
    for _, _, t, i in rows:
        ids = ids_of(own, t) + [0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    folder = scratch_path(spark, "files")
    index = token_files.write_token_files(cases.frame(spark), folder, BYTE, end_id=0)
    found = token_files.read_token_files(spark, folder).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert [s["base"] for s in index["shards"]] == [min(r[1] for r in expected), *(b["base"] + b["tokens"] for b in index["shards"][:-1])]
    shard = index["shards"][0]
    assert token_files.Shard(folder, shard["shard"], index["dtype"]).document(0).tolist() == ids_of(own, rows[0][2]) + [0]
    none = scratch_path(spark, "files")
    assert token_files.write_token_files(cases.empty(spark), none, BYTE)["shards"] == []
    assert token_files.read_token_files(spark, none).collect() == []
