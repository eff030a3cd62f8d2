"""Token counts, byte-level BPE and packing against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsieve.llm import best_fit, bpe_replay, token_counts
from tabsieve.llm.queries import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "It's 's  'S 'll don't", "ΑΣ ΟΔΟΣ Σ", "İstanbul ŞŞ ẞ", "<|endoftext|> a <|startoftext|>b <|x|>", "é Å ﬁ",
       "a\x1cb\x85c\xa0d e", "日本語 テキスト 🙂🙂", "!!'s ''' ¼² ½x 12345", "x" * 3000, " lead", "trail ", "a  b   c \n d\n\n e \t\tf", "ſ K k",
       "aaaaaaa" * 9, "tok" + "́" * 3]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def texts(small):
    import pyarrow.parquet as pq
    rows = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"], "clash") for r in rows] + [(10_000 + i, t, None) for i, t in enumerate(ODD)] + [(None, "null id", None)] * 2


def test_token_counts_equal_the_library(spark, texts):
    tokenizer = token_counts.load_tokenizer(WORD)
    got = token_counts.token_counts(spark.createDataFrame(texts, SCHEMA), "doc_id", "text", WORD, 50).collect()
    want = [(i, len((t or "").encode()), n, n > 50) for i, t, _ in texts
            for n in [len(tokenizer.encode(t or "", add_special_tokens=False).ids)]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts.token_counts(empty, "doc_id", "text", WORD, 50).count() == 0


def test_proved_tokens_are_single():
    proved = token_counts.single_tokens(WORD)
    tokenizer = token_counts.load_tokenizer(WORD)
    assert len(proved) > 20_000
    assert all(len(tokenizer.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(proved), 300))


@pytest.fixture(scope="module")
def library():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_replay.load_ranks(BYTE), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe_replay.Codec(bpe_replay.load_ranks(BYTE), public_tokenizers.PATTERN)


def test_bpe_equals_the_library_and_decodes(spark, texts, library):
    df = spark.createDataFrame(texts, SCHEMA)
    got = bpe_replay.encode_texts(df, "doc_id", "text", BYTE, public_tokenizers.PATTERN, slice_chars=5_000)
    want = {(i, tuple(library.encode_ordinary(t or ""))) for i, t, _ in texts}
    assert {(r["doc_id"], tuple(r["ids"])) for r in got.collect()} == want and got.count() == len(texts)
    decoded = bpe_replay.decode_ids(got, "doc_id", "ids", BYTE).collect()
    assert {(r[0], bytes(r[1])) for r in decoded} == {(i, (t or "").encode()) for i, t, _ in texts}
    digests = bpe_replay.encode_texts(df, "doc_id", "text", BYTE, public_tokenizers.PATTERN, digests=True).collect()
    assert {tuple(r) for r in digests} == {(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                            hashlib.sha256((t or "").encode()).hexdigest())
                                           for i, t, _ in texts for ids in [library.encode_ordinary(t or "")]}


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="ab's, \n\tÉ1!\x1c\x85🙂", max_size=40))
def test_bpe_cuts_white_space_as_the_library(codec, library, text):
    assert next(codec.encode([text])).tolist() == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12), max_size=6), st.integers(0, 40))
def test_replay_equals_single_words_for_any_ranks(words, seed):
    """Random ranks, also such as training never gives, so that lower ranks appear late."""
    rng = random.Random(seed)
    entries = [bytes([i]) for i in range(256)]
    more = {bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(2, 4))) for _ in range(40)}
    more = sorted(more)
    rng.shuffle(more)
    ranks = {e: i for i, e in enumerate([*entries, *more])}

    def plain(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    words = [*words, b"abab\x00ab", b"aaaaab", b"ab" * 9]
    merges = bpe_replay.merges_of(ranks)
    ids, counts = merges.replay(np.frombuffer(b"".join(words), np.uint8).astype(np.int32), np.array([len(w) for w in words]))
    ends = np.cumsum(counts)
    assert [ids[e - n:e].tolist() for e, n in zip(ends, counts)] == [plain(w) for w in words]
    assert [merges.single(np.frombuffer(w, np.uint8)).tolist() for w in words] == [plain(w) for w in words]


def brute_bins(lengths, capacity):
    """The rule piece by piece: large ones pair with the longest that fits, small ones go to the smallest gap."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        n = large.pop(0)
        other = next((m for m in large if n + m <= capacity), None)
        if other is not None:
            large.remove(other)
        gaps.append(capacity - n - (other or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity)
            fit = capacity
        gaps.remove(fit)
        gaps.append(fit - n)
    return sorted(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_packs_as_one_piece_at_a_time(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    fill, ranks = {}, {}
    for length, rank, n, first, offset in best_fit.plan(counts, 30):
        for i in range(n):
            fill.setdefault(first + i, []).append((offset, length))
            ranks.setdefault(length, []).append(rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in counts.items()}
    gaps = []
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        gaps.append(30 - at)
        assert sum(3 * n > 30 for _, n in pieces) <= 2
    assert sorted(fill) == list(range(len(fill)))
    assert sorted(gaps) == brute_bins(lengths, 30)


def test_packing_of_documents(spark, texts, monkeypatch):
    monkeypatch.setattr(best_fit, "RANK_GROUP", 7)
    capacity, tokenizer = 256, token_counts.load_tokenizer(WORD)
    got = best_fit.pack_documents(spark.createDataFrame(texts, SCHEMA), "doc_id", "text", WORD, capacity, with_ids=True).collect()
    want = []
    for i, t, _ in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(p), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), capacity)) for p in [ids[s:s + capacity]]]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        ends = [0]
        for offset, length in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity
    assert len(bins) == len(brute_bins([w[3] for w in want], capacity))
    empty = spark.createDataFrame([], SCHEMA)
    assert best_fit.pack_documents(empty, "doc_id", "text", WORD, capacity).count() == 0


def test_many_copies_of_one_length(spark):
    rows = spark.range(30_000).select("id", F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 97 + 1).alias("length"))
    out = best_fit.pack(rows, ["id"], 128).cache()
    assert out.count() == 30_000 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 128").count() == 0
    assert out.select("sequence_id", "offset").distinct().count() == 30_000
