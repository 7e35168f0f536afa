"""The encoder against the tokenizer itself, on texts of every kind of white space, words and junk, with a cache that keeps overflowing."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veilspark.llm import token_files
from veilspark.llm.queries import TOKENIZER

PIECES = ["the", "The", "don't", "x" * 40, "42", "3.14", "日本", "é", "á", "\U0001f600", "<|endoftext|>", "<|endof", "\n", "\n\n", "\t", "\r\n", "  ", " ", "　", " ", "\x00", "\x1c", "\x85", "'s", "''", "--", "_", "​", "﻿", "ſ", "İ"]


@pytest.mark.parametrize("kept", [0, 200, 24 << 20])
def test_ids_are_those_of_the_library(monkeypatch, kept):
    monkeypatch.setattr(token_files, "_KEPT", kept)
    monkeypatch.setattr(token_files, "_PORTION", 3_000)
    model = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    encoder, rng = token_files._Encoder(model, 2), random.Random(5)
    texts = ["", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n b", "a \nb", "word " * 5_000, *PIECES]
    for _ in range(3_000):
        space = rng.choice([" ", " ", " ", "", "\n"])
        texts.append(space.join(rng.choice(PIECES[:13] if rng.random() < 0.7 else PIECES) for _ in range(rng.randrange(1, 12))))
    expected = [[*model.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    found = []
    for part in token_files._portions(pa.array(texts)):
        ids, ends = encoder.encode(part)
        at = 0
        for end in ends.tolist():
            found.append(ids[at:end].tolist())
            at = end
        assert at == len(ids)
    assert found == expected
