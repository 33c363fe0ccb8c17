"""Alignment against a walk over the bytes of whole texts, and counts against one dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import alignment, queries
from newsloom.llm.sentence_pieces import codec

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_table():
    """Byte-level letters, from their published rule: bytes that print stand for themselves, the rest count up from 256."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}


LETTERS = byte_table()


def walk(libraries, text, overlaps=False):
    """(A ids, B ids, groups as text, links) of a whole text, byte by byte; None where it has no tokens."""
    a, b = libraries
    if not text:
        return None
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    ends = lambda parts: np.cumsum(list(map(len, parts))).tolist()
    a_end, b_end = ends(a_bytes), ends(b_bytes)
    groups, i, j = [], 0, 0
    for cut in sorted(set(a_end) & set(b_end)):
        left, right = [], []
        while i < len(a_end) and a_end[i] <= cut:
            left.append(a_ids[i])
            i += 1
        while j < len(b_end) and b_end[j] <= cut:
            right.append(b_ids[j])
            j += 1
        groups.append((left, right))
    if overlaps:
        links = [(a_ids[i], b_ids[j]) for i in range(len(a_ids)) for j in range(len(b_ids)) if max(a_end[i] - len(a_bytes[i]), b_end[j] - len(b_bytes[j])) < min(a_end[i], b_end[j])]
    else:
        at = {e: x for e, x in zip(b_end, b_ids, strict=True)}
        links = [(x, at[e]) for e, x in zip(a_end, a_ids, strict=True) if e in at]
    return a_ids, b_ids, ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups), len(groups), links


def expected(libraries, rows, overlaps=False):
    found = [(d, walk(libraries, t, overlaps)) for d, t in rows]
    counts = Counter(x for _, f in found if f for x in f[4])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, shown, n, links = f
            out.append((d, len(a), len(b), n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a", "the", " ", "  ", "\n", "\r\n", "\t", " ", " ", "é", "中文", "🙂", "<|endoftext|>", "</s>", "'s", "'", "12", "3", ",", "...", "ing", "\0", "_", "ß", "word", " new"]


def test_query_equals_walk(spark, sf_dir, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op13_alignment"](spark, sf_dir)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == expected(libraries, rows)


@pytest.mark.parametrize("overlaps", [False, True])
def test_odd_texts(spark, libraries, overlaps, monkeypatch):
    """Nulls, blanks, marks of the vocabularies inside texts, repeated and null ids, clashing columns, several blocks."""
    rng = random.Random(7)
    rows = [(None, "again and again"), (1, "again and again"), (1, "again and again"), (2, None), (3, ""), (4, " "), (5, "a ▁ b"), (6, "  two  blanks "), (7, "x" * 3000), (8, "<|endoftext|> <s>"), (None, None)]
    rows += [(10 + k, "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 40)))) for k in range(150)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, links int")
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 500)
    got = alignment.align(docs, A, B, overlaps=overlaps).collect()
    assert sorted(map(tuple, got), key=repr) == expected(libraries, rows, overlaps)
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_groups_as_text(spark, libraries):
    docs = spark.createDataFrame([(1, "Überprüfung of tokenizers"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in alignment.align(docs, A, B, groups=True).collect()}
    assert got == {1: walk(libraries, "Überprüfung of tokenizers")[2], 2: ""}


def test_chunks_are_cut_where_both_tokenizers_cut(libraries):
    rng = random.Random(8)
    own = codec(B)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 12)))
        parts = alignment.chunks(text)
        assert " ".join(parts) == text
        a = libraries[0]
        assert [i for p in parts for i in a.encode(" " + p, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
        assert [i for p in parts for i in own.encode([p], ends=False)[0].tolist()] == libraries[1].encode(text)


def test_coalesce_breaks_where_both_end():
    """Sizes 2,3|1 against 5|1 over two texts: one group of two to one, and one of one to one."""
    a_group, b_group, left, right = alignment.coalesce(np.array([2, 3, 1]), np.array([5, 1]), np.array([0, 0, 1]), np.array([0, 1]))
    assert a_group.tolist() == [0, 0, 1] and b_group.tolist() == [0, 1]
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(1, 0), (2, 1)]
    *_, left, right = alignment.coalesce(np.array([2, 3, 1]), np.array([5, 1]), np.array([0, 0, 1]), np.array([0, 1]), overlaps=True)
    assert list(zip(left.tolist(), right.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1)]
