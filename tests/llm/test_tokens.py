import zlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tabloom.llm import byte_bpe, packing, token_counts

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
CODEC = byte_bpe.ByteBpe(byte_bpe.MinimalPerfectHash(RANKS), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from("abcdeé ß\n\t 12,.'sİΣ🎉日\x00\x1c▁<>"), max_size=60) | st.text(max_size=40)


def test_minimal_perfect_hash_fills_every_slot():
    h = byte_bpe.MinimalPerfectHash(RANKS)
    assert sorted(h.values) == sorted(RANKS.values())
    assert all(h.get(k) == v for k, v in list(RANKS.items())[::97])
    assert h.get(b"no such token at all") == -1
    assert byte_bpe.MinimalPerfectHash({}).get(b"x") == -1


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_bpe_equals_the_library_and_round_trips(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_byte_bpe_takes_very_long_pieces():
    for text in ("a" * 20_000, " " * 5_000, "ab" * 4_000 + "\n"):
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_equal_the_unigram_tokenizer(text):
    counter = test_counts_equal_the_unigram_tokenizer
    if not hasattr(counter, "own"):
        counter.own = token_counts.UnigramCounter(PIECES)
        counter.library = Tokenizer(models.Unigram(PIECES, 0, byte_fallback=True))
        counter.library.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    assert counter.own.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)


UNTOUCHED = Tokenizer.from_file(WORDS)
MARKED = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "endoftext|>", "It's", " don't ", "ĀßİŁǅɏɐ", "x²½٣", "e\u0301", "\x1c\x85\xa0", "K", "日本"]) | TEXT, max_size=6).map("".join)


@settings(max_examples=600, deadline=None)
@given(MARKED)
def test_words_equal_the_library(text):
    assert packing.encoder(WORDS).encode(text).tolist() == UNTOUCHED.encode(text, add_special_tokens=False).ids


def test_latin_characters_equal_the_library():
    enc = packing.encoder(WORDS)
    for k in range(packing.LATIN_END + 64):
        for text in (chr(k), f"a{chr(k)}b", f"1{chr(k)}'{chr(k)}s"):
            assert enc.encode(text).tolist() == UNTOUCHED.encode(text, add_special_tokens=False).ids, k


def brute_pieces(rows):
    """What pieces there are, by the untouched tokenizer."""
    out = []
    for i, text in rows:
        ids = np.array([*UNTOUCHED.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    return sorted(out, key=str)


def sound(out):
    """Every sequence is gapless from 0 and holds 2048 tokens at most."""
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048


def test_op6_equals_brute_force(spark, tmp_path):
    rows = [(k, "Wort's " * (37 * k % 900), "c") for k in range(120)] + [(200, None, None), (201, "", "c"), (202, "lang é " * 9000, "c"), (5, "noch 12<|endoftext|>mal", "c")]
    rows += [(None, "same <|startoftext|> text", "c")] * 40 + [(7, "x" * 70_000, "c")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, _shard string").withColumns({"length": F.lit("n"), "piece": F.lit("n"), "_row": F.lit("n"), "sequence_id": F.lit("n")})
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = packing.op6_packing(spark, str(tmp_path)).toPandas()
    assert out.columns.tolist() == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got, key=str) == brute_pieces([r[:2] for r in rows])
    sound(out)
    assert out.sequence_id.nunique() <= np.ceil(out.length.sum() / 2048) * 1.1
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0


def test_equal_rows_spread_over_shards(spark):
    df = spark.createDataFrame([(None, "one two")] * 400, "doc_id long, text string")
    out = packing.pack_documents(df, WORDS, shard_pieces=50).toPandas()
    sound(out)
    shards = (out.sequence_id // (1 << 40)).value_counts()
    assert len(shards) == 8 and shards.max() < 100


def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "hello world", "x")], "doc_id long, text string, ids string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.encode_documents(df, path).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(df, path), path).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"hello world", b"hello world"]
    assert byte_bpe.round_trip_digests(df.limit(0), path).count() == 0
    counts = token_counts.token_counts(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id, r.n_tokens > 0) for r in counts) == [(1, True), (1, True), (2, False), (3, False)]


def test_packing_is_whole_gapless_and_tight(spark):
    texts = [(k, "wort " * (37 * k % 900)) for k in range(300)] + [(300, None), (301, "lang " * 9000), (5, "noch")]
    out = packing.pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), WORDS).toPandas()
    enc = packing.encoder(WORDS)
    assert out.length.sum() == sum(len(enc.encode(t or "")) + 1 for _, t in texts)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.concatenate([[0], g.length.cumsum()[:-1]]).tolist() and g.length.sum() <= 2048
    whole = out[out.doc_id == 301].sort_values("piece")
    assert whole.start.tolist() == [2048 * k for k in range(len(whole))] and (whole.length[:-1] == 2048).all()
    assert out.sequence_id.nunique() <= np.ceil(out.length.sum() / 2048) * 1.05 + 1


def test_placing_takes_the_least_sum_of_squares():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 21, 200)
    bins, offsets = packing.place(lengths, 20)
    gaps: dict[int, int] = {}

    for s, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        options = {}
        for target in {*gaps, "new"}:
            after = dict(gaps)
            gap = 20 if target == "new" else after[target]
            if gap < s:
                continue
            after["n" if target == "new" else target] = gap - s
            options[target] = sum(sum(1 for v in after.values() if v == g) ** 2 for g in range(1, 20))
        chosen = b if b in gaps else "new"
        assert options[chosen] == min(options.values())
        assert at == 20 - gaps.get(b, 20)
        gaps[b] = gaps.get(b, 20) - s

    assert min(gaps.values()) >= 0
