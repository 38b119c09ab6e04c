"""Operators on token ids: token files, SentencePiece spans, packing."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelwright.llm import packing, sentencepiece_spans, token_files
from panelwright.llm.bpe import encoder, public_file

BYTES, WORDS, PIECES = map(public_file, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABET = "ab1!'s \n\t\r\x0b\x1c ́é中İ’.,▁<|endoftext|>"


def library(path, texts):
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return [x.ids for x in tool.encode_batch(texts, add_special_tokens=False)]


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@given(texts=st.lists(st.text(ALPHABET, max_size=30) | st.text(max_size=12), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_chunked_encoding_is_the_library_s(path, texts):
    texts = [t for t in texts if t.isascii() or t.encode("utf-8", "ignore").decode() == t]
    ids, bounds = encoder(path).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library(path, texts)


PARTS = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "endoftext|>", "one", "It's", " ", "  ", "\n", "\t", "\x1c", ".", "<", "|>", "é", "\u0338"])


@pytest.mark.parametrize("path", [BYTES, WORDS])
@given(texts=st.lists(st.lists(PARTS, max_size=9).map("".join), min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_special_tokens_are_the_library_s(path, texts):
    texts = [*texts, "one <|endoftext|> two"]
    ids, bounds = encoder(path).encode(pa.array(texts, pa.string()))
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    assert len(want[-1]) == (4 if path == BYTES else 3)


def test_token_files_hold_special_tokens(spark, tmp_path):
    texts = ["one <|endoftext|> two", "three"]
    token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "t"), BYTES)
    got = sorted(map(tuple, token_files.read_digests(spark.read.parquet(str(tmp_path / "t"))).collect()))
    assert [r[:3] for r in got] == [(0, 0, 5), (1, 5, 2)]


@given(texts=st.lists(st.text(ALPHABET, max_size=30), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_spans_cover_the_source(texts):
    tool = sentencepiece_spans.span_encoder(PIECES)
    for text, (ids, first, last) in zip(texts, tool.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == tool.library.encode(text)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(first, last, strict=True)) == raw
        for i, a, b in zip(ids.tolist(), first, last, strict=True):
            piece = tool.library.id_to_piece(i)
            if not tool.library.is_byte(i):
                assert raw[a:b].decode().replace(" ", "▁") in (piece, piece[1:])


def test_character_map_takes_the_longest_prefix():
    """A compiled map written by hand: "a" -> "x", "ab" -> "yz"; units are indexed by base ^ byte."""
    units = [0] * 1024
    def unit(label, offset, leaf):
        return label | leaf << 8 | offset << 10
    units[0] = 256 << 10
    place_a = 256 ^ ord("a")
    units[place_a] = unit(ord("a"), place_a ^ 512, 1)
    units[512] = 0x80000000 | 0  # value of "a"
    place_ab = 512 ^ ord("b")
    units[place_ab] = unit(ord("b"), place_ab ^ 768, 1)
    units[768] = 0x80000000 | 2  # value of "ab"
    blob = (4096).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    table = sentencepiece_spans.CharacterMap(blob)
    text, source = table.normalise("abaéa")
    assert text == "yzxéx" and source.tolist() == [0, 0, 2, 3, 3, 5, 6]


def test_sentencepiece_documents(spark, awkward, empty):
    tool = sentencepiece_spans.span_encoder(PIECES).library
    got = sentencepiece_spans.digests(sentencepiece_spans.encode_documents(awkward, PIECES)).collect()
    want = collections.Counter()
    for i, text in rows_of(awkward):
        ids = [1, *tool.encode(text), 2]
        packed = np.array(ids, "<u4").tobytes()
        want[(i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(tool.decode(ids).encode()).hexdigest(), len(text.encode()))] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert sentencepiece_spans.encode_documents(empty, PIECES).count() == 0


@given(st.lists(st.integers(0, 40), max_size=3000), st.integers(0, 3000), st.integers(0, 3000))
@settings(max_examples=40, deadline=None)
def test_grammar_opens_anywhere(ids, start, length):
    ids = np.array(ids * 3, np.uint16)
    rules, lengths, symbols = token_files.compress(ids, 50_257)
    shard = token_files.Shard(50_257, rules.tobytes(), lengths.tobytes(), symbols.tobytes())
    assert (shard.read(0, len(ids)) == ids).all()
    start = min(start, len(ids))
    length = min(length, len(ids) - start)
    assert (shard.read(start, length) == ids[start : start + length]).all()


def test_grammar_shrinks_repeats():
    ids = np.tile(np.arange(1000, 1100, dtype=np.uint16), 400)
    assert len(token_files.compress(ids, 50_257)[2]) < len(ids) / 10


def test_token_files(spark, awkward, empty, tmp_path, monkeypatch):
    for name, df in (("awkward", awkward), ("documents", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), ("empty", empty)):
        path = str(tmp_path / name)
        token_files.write_token_files(df, path, BYTES)
        shards = spark.read.parquet(path)
        got = sorted(map(tuple, token_files.read_digests(shards).collect()), key=lambda r: r[1])
        rows = sorted(rows_of(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        start, want = 0, []
        for (i, _), ids in zip(rows, library(BYTES, [t for _, t in rows]), strict=True):
            packed = np.array([*ids, 0], "<u4").tobytes()
            want.append((i, start, len(ids) + 1, zlib.crc32(packed)))
            start += len(ids) + 1
        assert got == want
        assert {zlib.crc32(r.ids) for r in token_files.read_documents(shards).collect()} == {w[3] for w in want}


def check_packing(df, length, got):
    ids = collections.defaultdict(list)
    rows = rows_of(df)
    for (i, _), x in zip(rows, library(WORDS, [t for _, t in rows]), strict=True):
        ids[i].append(np.array([*x, 2], "<u4"))
    by_doc = collections.defaultdict(list)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        starts = collections.Counter((p.start, p.length) for p in pieces)
        if len(ids[i]) == 1 or len({x.tobytes() for x in ids[i]}) == 1:
            assert sum(p.length for p in pieces) == sum(map(len, ids[i]))
        assert starts
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return sorted(sum(n for _, n in x) for x in sequences.values())


def test_packing(spark, awkward, empty):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df, length in ((documents, 4096), (documents, 512), (awkward, 4096)):
        used = check_packing(df, length, packing.pack(df, WORDS, length=length).collect())
        if df is documents:
            assert sum(x < length for x in used) <= 1
    assert packing.pack(empty, WORDS).count() == 0


@given(st.dictionaries(st.integers(1, 256), st.integers(1, 500), min_size=1, max_size=25))
@settings(max_examples=40, deadline=None)
def test_patterns_hold_all_demand(histogram):
    weights = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[w] for w in weights], np.int64)
    patterns = packing.cutting_patterns(weights, demand, 256)
    assert all((p * weights).sum() <= 256 and n > 0 for p, n in patterns)
    assert (sum(p * n for p, n in patterns) == demand).all()
    bound = -(-int((weights * demand).sum()) // 256)
    big = int(demand[weights > 128].sum())
    assert sum(n for _, n in patterns) <= max(bound, big) * 1.3 + len(weights) + 1


def test_column_generation_beats_greedy():
    """Greedy filling pairs the halves and wastes room later; the program mixes all three."""
    weights, demand = np.array([52, 76, 128]), np.array([2000, 1000, 1000])
    assert sum(n for _, n in packing.cutting_patterns(weights, demand, 256)) <= 1251


@pytest.mark.parametrize("words, texts", [(4, 4000), (24, 1500), (95, 700)])
def test_packing_of_short_texts(spark, words, texts):
    """All sequences but the last are full, whatever the length of the texts."""
    some = "the of and to in is you that it he was for on are as with his they at be this have from or".split()
    rng = np.random.default_rng(words)
    rows = [(i, " ".join(rng.choice(some, max(1, rng.poisson(words))))) for i in range(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    used = check_packing(df, 4096, packing.pack(df, WORDS).collect())
    assert sum(x < 4096 for x in used) <= 1


def _plain_rounds(ids, base):
    """The grammar by dictionaries: pairs counted, the most frequent ones replaced from the left, round by round."""
    seq, rules = list(ids), []
    while len(seq) > 1:
        counts = collections.Counter(zip(seq, seq[1:]))
        often = sorted((p for p, n in counts.items() if n >= token_files.MIN_COUNT), key=lambda p: (-counts[p], p))[: token_files.ROUND_RULES]
        if not often:
            break
        number = {p: base + len(rules) + i for i, p in enumerate(sorted(often))}
        out, i = [], 0
        while i < len(seq):
            # Every second of consecutive occurrences is replaced.
            run = i
            while run + 1 < len(seq) and (seq[run], seq[run + 1]) in number:
                run += 1
            for k in range(i, run, 2):
                out.append(number[seq[k], seq[k + 1]])
            if (run - i) % 2 == 0:
                out.append(seq[run])
            i = run + 1
        rules += sorted(often)
        saved, seq, before = len(seq) - len(out), out, len(seq)
        if saved < token_files.ROUND_GAIN * before:
            break
    return rules, seq


@pytest.mark.parametrize("base", [12, 40, 60_000])
def test_grammar_is_that_of_a_plain_search(base):
    ids = np.random.default_rng(base).zipf(1.6, 20_000) % min(base, 40)
    ids = (base - 1 - ids).astype(np.uint16)
    rules, lengths, symbols = token_files.compress(ids, base)
    want_rules, want_symbols = _plain_rounds(ids.tolist(), base)
    assert list(map(tuple, rules.tolist())) == want_rules and symbols.tolist() == want_symbols
    shard = token_files.Shard(base, rules.tobytes(), lengths.tobytes(), symbols.tobytes())
    assert shard.read(0, len(ids)).tolist() == ids.tolist()
