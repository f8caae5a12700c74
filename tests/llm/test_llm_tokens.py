import gc
import random

import brute
import public_tokenizers
import pytest
from llm_helpers import SF

from terralake.llm import bpe


def test_whole_table_equals_the_library(documents, texts):
    encoding = brute.library()
    found = {r[0]: tuple(r[1:]) for r in bpe.digests(documents).collect()}
    assert found == {i: brute.token_digests(encoding, t) for i, t in texts.items()}


def test_pieces_equal_the_library():
    encoding, encoder = brute.library(), bpe.Encoder(bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN))
    rng = random.Random(1)
    tokens = list(encoder.v.ranks)
    for _ in range(3000):
        piece = b"".join(rng.choices(tokens, k=rng.randint(1, 5)))[:60] if rng.random() < 0.6 else bytes(rng.choices(range(256), k=rng.randint(1, 30)))
        assert encoder.encode(piece) == encoding._encode_single_piece(piece)
    for piece in (b"a" * 5000, b"ab" * 3000, b" " * 4000, bytes(range(256)) * 8):
        assert encoder.encode(piece) == encoding._encode_single_piece(piece)


def test_a_vocabulary_that_merges_cannot_make_is_refused():
    single = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="no merges"):
        bpe.Vocabulary(single | {b"abc": 256}, ".")
    with pytest.raises(ValueError, match="later"):
        bpe.Vocabulary(single | {b"abc": 256, b"ab": 257}, ".")
    with pytest.raises(ValueError, match="single byte"):
        bpe.Vocabulary({b"a": 0}, ".")


def test_odd_rows_and_lists_of_ids(odd):
    encoding = brute.library()
    made = bpe.decode(bpe.encode(odd)).collect()
    assert len(made) == odd.count() and made[0]._fields if hasattr(made[0], "_fields") else made[0].__fields__ == ["doc_id", "ids", "n_tokens", "decoded"]
    wanted = sorted((str(i), encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd.select("doc_id", "text").collect())
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in made) == wanted
    assert bpe.digests(odd.limit(0)).collect() == []


def test_encoders_go_with_their_task(documents, monkeypatch):
    """Python workers live on, and what an encoder remembers would stay in each of them."""
    makes, map_texts = [], bpe.map_texts
    monkeypatch.setattr(bpe, "map_texts", lambda rows, make, fields: makes.append(make) or map_texts(rows, make, fields))
    bpe.encode(documents)
    of_texts = makes[0]()
    assert of_texts(["some words"])[1].to_pylist() == [len(brute.library().encode_ordinary("some words"))]
    alive = lambda: sum(type(o) is bpe.Encoder for o in gc.get_objects())
    assert alive() == 1
    del of_texts
    assert alive() == 0


def test_query(spark):
    from terralake.llm.registry import QUERIES

    assert QUERIES["op3_bpe"](spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
