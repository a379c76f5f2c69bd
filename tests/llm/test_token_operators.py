"""Token counts, ids, BPE and packing against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from inspectra.llm.bm25_packing import B, K1, ShardIndex, op10_bm25_packing, pack, packed_documents
from inspectra.llm.fst_tokens import op2_fst_token_counts, token_counts
from inspectra.llm.huffman_ids import code_lengths, op3_huffman_ids, read_ids, write_ids
from inspectra.llm.merge_replay import decode_bpe, encode_bpe, op6_merge_replay
from inspectra.llm.word_ids import token_ids

HARD = [None, "", " ", "\n \t ", "a", "it's we'll THEY'RE x'd'", "don''t '' 'll", "naïve Ωmega 中文字 １２３ ½", "a\x00b \x1c\x1d c", "  two  blanks\n\n\nlines  ", "<|endoftext|> and <|startoftext|>", "x" * 5000, "ab " * 3000, "é" * 700, "👩‍👩‍👧 🇩🇪", "!!!???...,,,", "1234567890" * 50, " nbsp em", "İstanbul ẞ ǅ", "tail  "]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(3, HARD[4], "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def word_ids(texts, end):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [np.array([*x.ids, end], "<u4") for x in t.encode_batch(texts, add_special_tokens=False)]


def test_counts(spark, sf_dir, texts, hard):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in op2_fst_token_counts(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    want = dict(zip(texts, (len(x.ids) for x in t.encode_batch(list(texts.values()), add_special_tokens=False))))
    assert {i: r["n_tokens"] for i, r in got.items()} == want
    assert all(got[i]["n_bytes"] == len(x.encode()) and got[i]["over_limit"] == (want[i] > 512) for i, x in texts.items())
    rows = sorted((r["doc_id"], r["n_tokens"]) for r in token_counts(hard, P.path("byte_bpe_50k.json")).collect())
    assert rows == sorted([(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(HARD)] + [(3, len(t.encode(HARD[4]).ids))])


def test_huffman_file(spark, sf_dir, texts):
    got = sorted(op3_huffman_ids(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    docs = sorted(texts)
    at = 0
    for r, d, ids in zip(got, docs, word_ids([texts[d] for d in docs], 2)):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_huffman_edges(spark, hard, tmp_path):
    path = P.path("word_bpe_49k.json")
    folder = f"file://{tmp_path}/f"
    write_ids(token_ids(hard, path, 2), folder, "<u2", 49408)
    rows = sorted(read_ids(spark, folder).collect(), key=lambda r: r["start"])
    want = [(i, x.tobytes()) for i, x in enumerate(word_ids([x or "" for x in HARD], 2))]
    want.append((3, want[4][1]))
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in rows) == sorted(want)
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    empty = f"file://{tmp_path}/empty"
    write_ids(token_ids(hard.limit(0), path, 2), empty, "<u2", 49408)
    assert read_ids(spark, empty).count() == 0


def test_code_lengths():
    counts = np.array([1 << i for i in range(30)])
    n = code_lengths(counts, 8)
    assert n.max() <= 8 and sum(2.0 ** -n) == 1.0
    assert code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]


def test_merge_replay(spark, sf_dir, texts, hard):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    raw = lambda x: np.array(t.encode_ordinary(x), "<u4").tobytes()
    got = op6_merge_replay(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        x = texts[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(raw(x)) // 4, digest(raw(x)), digest(x.encode()))
    ids = encode_bpe(hard, path)
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in ids.collect()) == sorted([(i, raw(x or "")) for i, x in enumerate(HARD)] + [(3, raw(HARD[4]))])
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in decode_bpe(ids, path).collect()) == sorted([(i, (x or "").encode()) for i, x in enumerate(HARD)] + [(3, HARD[4].encode())])
    assert encode_bpe(hard.limit(0), path).count() == 0


def packing_is_whole(got, want, window=2048):
    """Every id of every document in exactly one piece; sequences gapless and of at most `window` ids."""
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, copies in want.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d])
        expect = []
        if len(copies) == 1:
            at = 0
            for start, n, crc in pieces:
                assert start == at and crc == zlib.crc32(copies[0][start : start + n].tobytes())
                at += n
            assert at == len(copies[0])
        else:
            expect = sum(len(c) for c in copies)
            assert sum(n for _, n, _ in pieces) == expect
    used = padded = 0
    for rows in by_seq.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= window
        used += at
        padded += at if at & (at - 1) == 0 else window
    assert set(by_doc) == set(want)
    return used / max(padded, 1)


def test_packing(spark, sf_dir, texts, hard):
    want = {d: [x] for d, x in zip(texts, word_ids(list(texts.values()), 1))}
    got = op10_bm25_packing(spark, sf_dir).collect()
    assert packing_is_whole(got, want) == 1.0
    assert all(r["doc_tokens"] == len(want[r["doc_id"]][0]) for r in got)
    small = {}
    for i, x in [*enumerate(HARD), (3, HARD[4])]:
        small.setdefault(i, []).extend(word_ids([x or ""], 1))
    packing_is_whole(packed_documents(spark, hard, P.path("word_bpe_49k.json")).collect(), small)
    assert packed_documents(spark, hard.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_bm25_of_all_terms():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint16) for _ in range(60)] + [np.arange(400, 900, dtype=np.uint16), np.array([899], np.uint16)]
    idf, mean = rng.random(900) + 0.01, 90.0
    index = ShardIndex(docs, idf, mean)
    for seed in (0, 7, 60, 61):
        for d, x in enumerate(docs):
            want = sum(idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(x) / mean)) for t in set(docs[seed].tolist()) if (n := int((x == t).sum())))
            assert abs(index.scores(seed)[d] - want) < 1e-9


def test_long_documents_are_matched_whole(spark):
    """The end of a document of 65 ids is its end id alone; its neighbours share the 64 ids before."""
    like = [5] * 8 + [6] * 8
    docs = [(0, [5] * 32 + [6] * 32 + [1]), *((i, [10 + i] * 15 + [1]) for i in range(1, 6)), (6, [*like, 1])]
    rows = [(d, len(x), np.array(x, "<u2").tobytes()) for d, x in docs]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary"), "<u2", 32, 32).collect()
    at = {(r["doc_id"], r["start"]): (r["sequence_id"], r["offset"]) for r in got}
    assert at[0, 64][1] == 0 and at[6, 0] == (at[0, 64][0], 1)


def test_counts_of_long_pieces(monkeypatch):
    """Chunks of any size, and first states that are guessed wrongly."""
    import random

    from inspectra.llm import fst_tokens

    t, counter, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), fst_tokens.TokenCounter(P.path("byte_bpe_50k.json")), random.Random(4)
    parts = "the of ing tion er an re and qu xz zzz aa é".split()
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (10, 900, 20_000)] + ["a" * 5000, "x" * 2049, "=-" * 4000, " " * 6000, "1" * 9000]
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    for chunk, warm_up in ((512, 48), (64, 3), (7, 0)):
        monkeypatch.setattr(fst_tokens, "CHUNK", chunk)
        monkeypatch.setattr(fst_tokens, "WARM_UP", warm_up)
        assert counter.count(texts).tolist() == want
