"""The encoder against the library on hard pieces, and what its memo keeps."""

import random
import time

import numpy as np
import pytest
from test_queries import tiktoken_encoder

from gristmill.llm import bpe
from gristmill.llm import queries as q


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(*q.tokenizer())


def test_pieces_of_tokens_equal_the_library(own):
    """Tokens and parts of them side by side, so that the longest match is often the wrong one."""
    random.seed(6)
    encoder, pieces = own
    words = [t for b in encoder.ranks if (t := b.decode("utf-8", "ignore")).strip()]
    texts = ["", "\0", "ñ", "\U0001f600é" * 9, " \n\t " * 50, "'ll's'", "a" * 5000, "ab" * 3000 + "ñ", "ー" * 700]
    texts += ["".join(w if random.random() < 0.5 else w[: random.randint(1, len(w))] for w in random.choices(words, k=random.randint(1, 12))) for _ in range(3000)]
    texts += ["".join(w.strip().lower() for w in random.choices(words, k=random.randint(2, 9))) for _ in range(3000)]
    lib = tiktoken_encoder()
    for t in texts:
        ids = encoder.encode(pieces.findall(t))
        assert ids.tolist() == lib.encode_ordinary(t), t
        assert bytes(encoder.decode(ids)) == t.encode() and bytes(encoder.decimal(ids)).decode() == ",".join(map(str, ids.tolist()))


def test_a_long_piece_is_linear(own):
    """Also where one scan of longest tokens does not do."""
    encoder, _ = own
    began = time.time()
    piece = "ouedtionthretionthble" * 50_000
    assert bytes(encoder.decode(encoder.encode([piece]))) == piece.encode() and len(encoder.memo) < bpe.MEMO_PIECES
    assert time.time() - began < 60


def test_memo_keeps_what_recurs(own, monkeypatch):
    """Pieces seen once push out no piece that is asked for again; the memo stays bounded."""
    monkeypatch.setattr(bpe, "MEMO_PIECES", 100)
    asked = []
    memo = bpe.Memo(lambda piece: asked.append(piece) or own[0].encode_piece(piece))
    hot = [f" hot{i}" for i in range(20)]
    for i in range(2000):
        assert memo[hot[i % 20]] == np.array(own[0].encode_piece(hot[i % 20].encode()), np.int32).tobytes()
        memo[f" once{i}"]
        assert len(memo) + len(memo.older) <= 100
    assert len(asked) == 2000 + 20
    memo["x" * 1000]
    assert "x" * 1000 not in memo


def test_ids_that_are_no_tokens(own):
    with pytest.raises((KeyError, IndexError)):
        own[0].decode(np.array([1 << 30], np.int32))
