"""Lossless WebP, BPE transducers and the token-count cache."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rondel.llm import bpe, token_counts, webp
from rondel.llm.queries import PIECES, RANKS, split_pattern, tokenizer_path

TEXTS = ["", None, "a", "Hello, world!\n\n  It's 2024…", "é" * 70, "日本語テキスト 🎉👩‍👩‍👧 mixed", "\0\0\0", "x" * 20_000, "<|endoftext|> <s> ▁", " \t\n" * 40, "Ünïcödé ¼ ² ٣ Ⅷ 'll 's"]


def picture(kind, height, width, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "noise":
        return rng.integers(0, 1 << 32, (height, width), np.uint32)
    if kind == "few":
        return rng.choice(np.array([0xFF000000, 0xFFFFFFFF, 0x80123456, 0x00FF00FF, 0xFF112233][: seed + 1], np.uint32), (height, width))
    y, x = np.mgrid[:height, :width]
    return (0xFF << 24 | (x * 3 & 255) << 16 | (y * 5 & 255) << 8 | ((x + y) & 255)).astype(np.uint32)


@pytest.mark.parametrize("options", [{}, {"green": True}, {"cross": (3, -5, 40)}, {"palette": True}, {"cache_bits": 6}, {"references": True}, {"cache_bits": 3, "references": True, "green": True}, {"predictor": 11, "cross": (-9, 7, 1), "green": True, "cache_bits": 4, "references": True}], ids=str)
@pytest.mark.parametrize("size", [(1, 1), (1, 17), (9, 1), (13, 21)])
def test_webp_round_trip_of_all_transforms(options, size):
    for kind, seed in (("smooth", 0), ("few", 0), ("few", 1), ("few", 4), ("noise", 2)):
        pixels = picture(kind, *size, seed)
        if options.get("palette") and len(np.unique(pixels)) > 256:
            continue
        assert np.array_equal(webp.decode(webp.encode(pixels, **options)), pixels)


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    for kind in ("smooth", "noise"):
        pixels = picture(kind, 11, 14, mode)
        assert np.array_equal(webp.decode(webp.encode(pixels, predictor=mode)), pixels)


def test_webp_block_codes_by_meta_image():
    """Two groups of codes, chosen by a meta image, written by hand."""
    out = webp._head(8, 4)
    out.put(0, 1)  # no transform
    out.put(0, 1)  # no cache
    out.put(1, 1)  # meta image
    out.put(0, 3)  # blocks of 4 pixels
    webp._write_image(out, np.array([0xFF000000, 0xFF000100], np.uint32), 2, False, 0, False)
    for level in (10, 200):
        for symbol in (level, 0, level, 255, 0):
            webp.write_code(out, np.eye(1, 256, symbol, dtype=np.int64)[0])
    pixels = webp.decode(webp._file(out.value.to_bytes((out.n + 7) // 8, "little")))
    assert set(pixels[:, :4].ravel()) == {0xFF000A0A} and set(pixels[:, 4:].ravel()) == {0xFF00C8C8}


def test_webp_rejects_broken_files():
    good = webp.stored(webp.payload(b"some text " * 50))
    for bad in (b"", good[:40], b"RIFX" + good[4:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    assert len(webp.NEIGHBOURS) == 120 == len(set(webp.NEIGHBOURS))


def test_media_columns(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("media", F.lit(1))
    rows = {r.doc_id: r for r in webp.media_columns(docs, keep_media=True).collect()}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        data = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
    assert rows[0].feature == rows[1].feature
    assert webp.media_columns(docs.limit(0)).count() == 0


def test_stored_of_more_than_one_mebibyte():
    data = webp.payload(bytes(range(256)) * 5000)
    pixels = webp.decode(webp.stored(data))
    assert pixels.shape[1] == 1 << 14 and (pixels >> 8).astype(np.uint8).tobytes()[: len(data)] == data


@pytest.fixture(scope="module")
def own():
    with open(tokenizer_path(RANKS), "rb") as f:
        return bpe.codec(f.read(), split_pattern())


@pytest.fixture(scope="module")
def library(own):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_bpe_equals_the_library(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text


def test_bpe_ascii_pattern(own):
    rng = random.Random(1)
    for _ in range(300):
        piece = "".join(chr(rng.randrange(128)) for _ in range(60))
        assert own._split(piece) == own._split_ascii(piece)
    assert bpe.ascii_pattern(r"\p{L}{1,3}|[^\p{N}\]]+|\[x") == r"[A-Za-z]{1,3}|[^0-9\]]+|\[x"
    assert bpe.ascii_pattern(r"\p{Lu}+") is None


def test_bpe_of_long_and_odd_texts(own, library):
    rng = random.Random(2)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices("aeinorst", k=3000)), "".join(rng.choices("abAB019 .éß日", k=3000)), "0" * 500, "=" * 999, "\n" * 300]
    for text in texts:
        assert own.encode(text) == library.encode_ordinary(text)


def test_bpe_streaming_decoder(own):
    text = "naïve 日本語 🎉 text"
    ids = own.encode(text)
    decoder = bpe.Utf8Decoder(own.tokens)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text
    tokens = {i: bytes([i]) for i in range(256)}
    for raw in (b"\xff", b"a\xc3", b"\xe2\x82", b"\xe2\x28\xa1", b"\xf0\x9f\x8e", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80z", bytes(range(128, 256))):
        decoder = bpe.Utf8Decoder(tokens)
        assert decoder.feed(raw) + decoder.finish() == raw.decode(errors="replace")


def test_bpe_query_rows(spark, own):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("token_ids", F.lit("x"))
    rows = {r.doc_id: r for r in bpe.round_trip(docs, tokenizer_path(RANKS), split_pattern()).collect()}
    for i, text in enumerate(TEXTS):
        ids = own.encode(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    tokens = bpe.encoded(docs, tokenizer_path(RANKS), split_pattern())
    back = bpe.decoded(tokens, tokenizer_path(RANKS), split_pattern())
    assert {r.doc_id: (r.token_ids, r.decoded_text) for r in back.collect()} == {i: (own.encode(t or ""), t or "") for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(docs.limit(0), tokenizer_path(RANKS), split_pattern()).count() == 0


def test_bpe_of_a_small_rank_file():
    """Merges whose order matters, against the merge loop."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"bcd", b"cd", b"abcd", b"aa", b"aaa", b"aaaa"]
    raw = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    merges = bpe.Merges(bpe.parse_ranks(raw))
    machine = bpe.Transducer(merges)
    rng = random.Random(4)
    for _ in range(500):
        piece = bytes(rng.choices(b"abcd", k=rng.randint(1, 12)))
        parts = [merges.ranks[p] for p in merges.merge(piece)]
        assert machine.encode(piece) == parts, piece


def test_token_counts_and_cache(spark, tmp_path):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + TEXTS[2:5])], "doc_id bigint, text string").withColumn("content", F.lit(1)).withColumn("n_tokens", F.lit(1))
    cache = f"file://{tmp_path}/cache"
    rows = {r.doc_id: r for r in token_counts.token_counts(docs, tokenizer_path(PIECES), cache).collect()}
    for i, text in enumerate(TEXTS + TEXTS[2:5]):
        n = len(processor.encode(text or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((text or "").encode()), n, n > 4096)
    # null and the empty text are one content, and repeated texts add none.
    assert spark.read.parquet(cache).count() == len(TEXTS) - 1
    more = docs.union(docs.limit(1).select(F.lit(99).cast("long"), F.lit("new text"), "content", "n_tokens"))
    again = token_counts.token_counts(more, tokenizer_path(PIECES), cache)
    assert again.count() == docs.count() + 1
    assert spark.read.parquet(cache).count() == len(TEXTS)
    assert token_counts.token_counts(docs.limit(0), tokenizer_path(PIECES), f"file://{tmp_path}/none").count() == 0


def test_token_counts_by_another_version(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    cache = f"file://{tmp_path}/cache"
    token_counts.token_counts(docs, tokenizer_path(PIECES), cache).collect()
    other = token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json"), cache).collect()
    assert other[0].n_tokens == 3 and spark.read.parquet(cache).select("version").distinct().count() == 2
