"""The agenda codec against the library, on odd characters, long sequences and ids that no text has."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import queries, sentence_pieces
from newsloom.llm.sentence_pieces import PieceCodec

MODEL = queries.vocabulary("piece_bpe_32k.model")
ODD = ["a", "the", " ", "  ", "▁", "\n", "\0", "é", "é", "中", "🙂", "<s>", "</s>", "<0x41>", "ing", "\r\n", "\t", "�", " ", "ﬁ", "0", "12", "'s", "\x7f", "//"]


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL)


@given(st.text(st.one_of(st.sampled_from("ab ▁\n\0é中0,."), st.characters(exclude_categories=["Cs"])), max_size=30))
@settings(max_examples=400, deadline=None)
def test_round_trip_of_any_text(text):
    own = sentence_pieces.codec(MODEL)
    ids = own.encode([text])[0]
    assert ids.tolist() == own.library.encode(text, add_bos=True, add_eos=True)
    assert own.decode(ids) == own.library.decode(ids.tolist())


def test_long_sequences_use_a_heap(codec):
    """Sequences on both sides of SHORT, and very long ones with many equal pairs."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD + list("estranio")) for _ in range(rng.randrange(1, 400))).replace(" ", "") for _ in range(300)]
    texts += ["".join(rng.choice("abeinst") for _ in range(n)) for n in (38, 39, 40, 41, 42, 5000)] + ["q" * 30000 + "an" * 20000, " " * 3000, "", " "]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == codec.library.encode(text, add_bos=True, add_eos=True)
        assert codec.decode(ids) == codec.library.decode(ids.tolist())


def test_any_ids_decode_as_the_library_does(codec):
    """Bytes that make no character, control ids between bytes, unknowns and marks at the front."""
    rng = random.Random(4)
    mark = codec.ids["▁"]
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 1, 2, 0, mark]) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, dtype=int)) == codec.library.decode(ids)


def test_memo_turns_over(codec, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MEMO_SIZE", 50)
    own = PieceCodec(MODEL)
    for k in range(60):
        text = " ".join(f"w{j}x" for j in range(k, k + 20))
        assert own.encode([text])[0].tolist() == own.library.encode(text, add_bos=True, add_eos=True)
    assert len(own.memo) <= 90


def test_check_reports_other_ids(monkeypatch):
    """A codec whose agenda goes wrong for one word says so, for texts with that word only."""
    own = PieceCodec(MODEL, check=True)
    monkeypatch.setattr(own, "word_ids", lambda w, plain=own.word_ids: plain(w)[::-1] if w == "▁wrongly" else plain(w))
    texts = ["all is well\n\nhere  ▁ x", "rightly or wrongly", "", " ", "\0 é 中"]
    own.encode(texts)
    assert own.unlike == {"▁wrongly"} and [own.as_library(t) for t in texts] == [True, False, True, True, True]


def test_operators(spark):
    """Null and empty texts, repeated and null ids, clashing columns, an empty table; arrays, packed ids and decoding."""
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "x"), (3, "Hello  world\n▁ 中🙂", "x"), (4, "word " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sentence_pieces.encode_texts(docs, MODEL, decoded=True)
    assert got.columns == ["doc_id", "ids", "decoded", "as_library"]
    own = sentence_pieces.codec(MODEL)
    by_id = sorted(((r["doc_id"] or 0, r["ids"], r["decoded"], r["as_library"]) for r in got.collect()), key=lambda r: r[0])
    for (_, ids, text, same), (_, given_text, _) in zip(by_id, sorted(rows, key=lambda r: r[0] or 0), strict=True):
        assert same and ids == own.library.encode(given_text or "", add_bos=True, add_eos=True) and text == own.library.decode(ids)
    packed = sentence_pieces.encode_texts(docs, MODEL, ends=False, packed=True, check=False)
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packed.collect()}[3] == own.library.encode(rows[3][1])
    back = sentence_pieces.decode_ids(got.select("doc_id", "ids"), MODEL, into="text")
    assert {r["doc_id"]: r["text"] for r in back.collect()}[3] == "Hello  world\n  中🙂"
    with pytest.raises(ValueError):
        sentence_pieces.decode_ids(got, MODEL, into="IDS")
    assert sentence_pieces.encode_texts(docs.limit(0), MODEL).count() == 0


def test_query_equals_library(spark, sf_dir):
    import hashlib

    own = sentence_pieces.codec(MODEL).library
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op11_sentencepiece"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["as_library"]) == (len(ids), digest, hashlib.sha256(own.decode(ids).encode()).hexdigest(), True)
