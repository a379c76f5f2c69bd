"""Alignment of two tokenizers against a plain loop over tokens with the libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from inspectra.llm import token_alignment as A
from inspectra.llm.pretokens import class_table, matched_by_tiktoken, matched_by_tokenizers

HARD = [
    None, "", " ", "a", "Hello world", "  two  blanks ", "tab\tand\nline\r\n", "emoji \U0001f600 and 漢字", "don't we'll I'M", "<|endoftext|> and <s> </s>", "▁ low line", "fi ﬁ ligature", "é é", "nul\0in", "x" * 5000, "1234567890" * 30,
    "the cat sat on the mat", "the cat sat on the mat", "the dog", " hard blanks", "ñandú château Übergröße", "﻿mark",
]


def brute(rows):
    a_lib, b_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_lib.encode_special_tokens = True
    chars = A.byte_characters()
    docs = []
    for doc_id, text in rows:
        want, none = (" " + (text or "")).encode(), (doc_id, [], [], [], [])
        if not text:
            docs.append(none)
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        a_bytes = [bytes(chars[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            docs.append(none)
            continue
        ends = lambda parts: np.cumsum(list(map(len, parts))).tolist()
        ea, eb = ends(a_bytes), ends(b_bytes)
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - len(a_bytes[i]), eb[j] - len(b_bytes[j])) < min(ea[i], eb[j])]
        groups = ["|".join(",".join(str(x[k]) for k, e in enumerate(at) if low < e <= high) for x, at in ((a, ea), (b, eb))) for low, high in zip([0, *sorted(set(ea) & set(eb))], sorted(set(ea) & set(eb)))]
        docs.append((doc_id, a, b, groups, links))
    count = Counter(p for d in docs for p in set(d[4]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(i, len(a), len(b), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, links in docs], count


def test_hard_and_repeated_texts(spark, monkeypatch):
    rows = [(i % 19 or None, t) for i, t in enumerate(HARD)]
    monkeypatch.setattr(A, "LEAST_LINKS", 200)  # stripes are split
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, chunk string, stripe int")
    got, counts = A.aligned(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    want, pairs = brute(rows)
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    found = A.pair_counts(counts, 32_000).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in found} == pairs
    assert all(r.best == (r.n_docs == max(n for (a, _), n in pairs.items() if a == r.a_id)) for r in found)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.aligned(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))[0].count() == 0


def test_both_libraries_split_alike():
    assert (class_table(matched_by_tokenizers) == class_table(matched_by_tiktoken)).all()


def test_packing():
    for arrays in ([np.array([0, 255, 256])], [np.zeros(0, np.int64), np.array([1 << 40])]):
        assert [x.tolist() for x in A.unpacked(A.packed(*arrays))] == [x.tolist() for x in arrays]


def test_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 900").select("doc_id", "text")
    rows = sorted(map(tuple, docs.collect()))[:150]
    got = A.aligned(spark.createDataFrame(rows, docs.schema).repartition(3), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))[0]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows)[0])
