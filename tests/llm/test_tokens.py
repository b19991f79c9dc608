"""Token counts, byte-level BPE, id files and packing against the public libraries."""

import base64
import functools
import io
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxloom.llm import byte_bpe, id_files, packing, token_counts, wordbpe

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "Hello, WORLD's 12 apples!", "x" * 5000, "a <|endoftext|> b", "Été İstanbul ΣΣ 漢字 \U0001f600 é", "tab\tnl\n\n  \x85\xa0end", "don't 'tis ' 's", "\x1c\x1d\x00z", "½² ºªµ",
]
ROWS = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (3, TEXTS[3], "x", "y")]
SCHEMA = "doc_id long, text string, n_tokens string, ids string"


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def tik():
    with open(BYTE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def test_counts(spark, lib):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(spark.createDataFrame(ROWS, SCHEMA), WORD, limit=20).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(ids_of(lib, t)), n > 20) for i, t, *_ in ROWS), key=str)
    assert got == want
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_whole_tokens_are_proven(lib):
    whole = token_counts.prove_whole(WORD)
    assert len(whole) > 10_000 and all(len(ids_of(lib, w)) == 1 for w in list(whole)[:300])


@functools.cache
def word_counter():
    return token_counts.Counter(WORD, token_counts.prove_whole(WORD))


@pytest.fixture
def counter():
    return word_counter()


@pytest.mark.parametrize("text", [
    "“Curly” quotes — and a long dash … don’t", "Привет, мир! Как дела?", "日本語のテキスト 漢字 한국어", "mixed \U0001f600 emoji \U0001f468‍\U0001f469 ok",
    "<|endoftext|>", "<|endoftext|><|startoftext|>x", "e<|endoftext|>\u0301", "’<|startoftext|>‘s <|STARTOFTEXT|>", "<|endoftext|", "\u200b\ufeff \u2028",
])
def test_counts_of_any_script(lib, counter, text):
    for t in (text, text * 40, "plain words " + text):
        assert counter.count(t) == len(ids_of(lib, t))


def test_words_of_any_script_take_the_shortcut(counter, monkeypatch):
    words = [w for w in counter.whole if not w.isascii() and wordbpe.pieces(w) is None]
    assert len(words) > 50  # proven words outside the certain range
    asked = []
    monkeypatch.setattr(counter.bpe, "model", type("Model", (), {"tokenize": staticmethod(lambda p: asked.append(p) or [p])})())
    for memo in (counter.pieces, counter.letters, counter.chunks):
        memo.clear()
    assert counter.count("— " + " ".join(words[:50])) == 51 and asked in ([], ["âĢĶ"])
    for memo in (counter.pieces, counter.letters, counter.chunks):
        memo.clear()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "’", "\u0301", " ", "ß", "Привет", "the", "'S", "\u0327", "  ", "\u1100\u1161", "x" * 70, "ﬁ", "１２"]), max_size=12).map("".join)))
def test_counts_equal_the_libraries(text):
    counter = word_counter()
    text = text.encode("utf-8", "ignore").decode()
    assert counter.count(text) == len(counter.bpe.library_ids(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abzAÉé \n\t'st12²½٣漢\U0001f600　\x85\x1c\xa0!?-_ǅ́ ᠎​İıſΣ<|>", max_size=40))
def test_ids_equal_the_libraries(text):
    word, byte = wordbpe.load(WORD), byte_bpe.load(BYTE)
    assert list(array("I", word.ids(text))) == word.library_ids(text)
    ids = byte.encode(text)
    assert byte.decode(ids) == text.encode()


def test_byte_bpe(spark, tik):
    df = spark.createDataFrame(ROWS, SCHEMA)
    enc = byte_bpe.encode_documents(df, BYTE)
    got = sorted(((r["doc_id"], bytes(r["ids"])) for r in enc.collect()), key=str)
    assert got == sorted(((i, array("I", tik.encode_ordinary(t or "")).tobytes()) for i, t, *_ in ROWS), key=str)
    back = byte_bpe.decode_documents(enc, BYTE)
    assert sorted(((r["doc_id"], bytes(r["bytes"])) for r in back.collect()), key=str) == sorted(((i, (t or "").encode()) for i, t, *_ in ROWS), key=str)
    assert byte_bpe.round_trip(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_byte_bpe_on_documents(spark, sf_dir, tik):
    text = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    b = byte_bpe.load(BYTE)
    assert all(list(array("I", b.encode(t))) == tik.encode_ordinary(t) for t in text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=12), st.integers(1, 400))
def test_perfect_hash(seed, n):
    keys = [seed + i.to_bytes(2, "big") for i in range(n)]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.find(k) for k in keys) == list(range(n)) and h.find(seed + b"none") == -1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=300), max_size=8))
def test_shard_round_trip(docs):
    out = io.BytesIO()
    w = id_files.ShardWriter(out, flush=1)
    for i, d in enumerate(docs):
        w.add(i if i % 3 else None, array("I", d).tobytes())
    w.close()
    shard = id_files.Shard(out.getvalue())
    assert [(i, list(array("I", x))) for i, _, x in shard.documents(64)] == [(i if i % 3 else None, d) for i, d in enumerate(docs)]
    flat = [x for d in docs for x in d]
    assert shard.read_range(len(flat) // 3, len(flat)).tolist() == flat[len(flat) // 3 :]


def test_shard_damage_is_seen():
    out = io.BytesIO()
    w = id_files.ShardWriter(out)
    w.add(1, array("I", range(500)).tobytes())
    w.close()
    with pytest.raises(ValueError):
        id_files.Shard(out.getvalue()[:-9] + b"x" * 9)


def test_outliers_become_exceptions():
    ids = np.arange(128, dtype=np.uint32) % 4
    ids[5] = 40_000
    blocks, width = id_files.encode_blocks(ids)
    assert width.tolist() == [2] and len(blocks[0]) == 8 + 16 * 2 + 5


def test_id_files(spark, lib, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = f"file://{tmp_path}/ids"
    shards = id_files.write_id_files(df, WORD, out)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in id_files.read_id_files(spark, shards, out).collect())
    at, want = 0, []
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = array("I", [*ids_of(lib, t), 1]).tobytes()
        want.append((at, i, len(x) // 4, x))
        at += len(x) // 4
    assert got == want
    digests = {(r["start"], r["ids_crc32"]) for r in id_files.read_digests(spark, shards, out).collect()}
    assert digests == {(s, zlib.crc32(x)) for s, _, _, x in want}
    none = f"file://{tmp_path}/none"
    assert id_files.read_digests(spark, id_files.write_id_files(spark.createDataFrame([], SCHEMA), WORD, none), none).count() == 0


def test_packing(spark, sf_dir, lib):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "a b c " * 20_000), (10_003, "x")], docs.schema)
    df = docs.unionByName(extra)
    rows = packing.pack_documents(df, WORD, group_tokens=30_000, with_ids=True).collect()
    want = {r["doc_id"]: [*ids_of(lib, r["text"]), 2] for r in df.collect()}
    by_doc, by_seq = {}, {}
    for r in rows:
        part = list(array("I", bytes(r["ids"])))
        assert part == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))

    def gapless(parts):
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        return at

    assert {d: gapless(p) for d, p in by_doc.items()} == {d: len(x) for d, x in want.items()}
    sizes = [gapless(p) for p in by_seq.values()]
    padded = sum(4096 - n for n in sizes if n & (n - 1))
    parts = docs.rdd.getNumPartitions() + extra.rdd.getNumPartitions()
    assert max(sizes) <= 4096 and padded <= 4096 * parts and sum(1 for n in sizes if n not in packing.TIERS) <= parts
    assert packing.pack_documents(spark.createDataFrame([], df.schema), WORD).count() == 0
    # the same rows again give the same pieces
    again = packing.pack_documents(df, WORD, group_tokens=30_000, with_ids=True).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_step_groups_are_balanced():
    rng = np.random.default_rng(0)
    seqs = [(int(t), [(0, 0, int(t))]) for t in rng.choice(packing.TIERS, 4000)]
    groups = packing.deal(seqs, 1 << 16)
    load = np.bincount(groups, weights=[t for t, _ in seqs])
    assert len(load) > 50 and load.max() / load.min() < 1.35


def test_decode_of_odd_ids(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.load(ranks)
    ids = array("I", [bpe.ranks[b"the"], 50_256, 4_000_000_000, bpe.ranks[b" cat"]]).tobytes()
    df = spark.createDataFrame([(1, bytearray(ids), "x"), (2, bytearray(ids + b"\1\2"), "x"), (3, None, "x"), (None, bytearray(), "x")], "doc_id long, ids binary, bytes string")
    got = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode_documents(df, ranks).collect()}
    odd = b"the\xef\xbf\xbd\xef\xbf\xbd cat"
    assert got == {1: odd, 2: odd, 3: b"", None: b""}
    assert byte_bpe.decode_documents(df.limit(0), ranks).count() == 0


def test_shards_are_bounded_and_hot_ids_are_split(spark, lib, tmp_path):
    rows = [(None, f"null {k} words", "x") for k in range(150)] + [(7, f"seven {k}", "x") for k in range(120)] + [(k, f"text {k} of some words", "x") for k in range(100)] + [(500, "long " * 400, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(6)
    out = f"file://{tmp_path}/ids"
    shards = id_files.write_id_files(df, WORD, out, shard_ids=100)
    assert len(shards) > 16 and sum(n >= 110 for _, _, n in shards) == 1
    got = sorted(id_files.read_id_files(spark, shards, out).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    want = Counter((i, array("I", [*ids_of(lib, t), 1]).tobytes()) for i, t, _ in rows)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
