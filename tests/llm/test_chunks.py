"""The table of chunks: what it asks of its encoder, what it keeps, and texts that are split in other ways."""

import collections
import types

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stripweave.llm import bpe, huffman
from stripweave.llm.chunks import ChunkTable

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counting(most):
    asked = collections.Counter()

    def encode(chunks):
        asked.update(chunks)
        return [x.encode() for x in chunks]

    return ChunkTable(encode, {"<|end|>": b"E"}, most), asked


def test_frequent_chunks_are_encoded_once_however_many_pass():
    table, asked = counting(40)
    for k in range(200):
        assert table.encode([f" often rare{k:04d} seldom{k:04d}"]) == [f" often rare{k:04d} seldom{k:04d}".encode()]
        assert len(table.young) + len(table.old) <= 60
    assert asked[" often"] == 1


def test_words_and_their_tails_are_encoded_once():
    table, asked = counting(1000)
    texts = [" word### word,%% word! word", "word<|end|>, Word's. 'tis.'"]
    assert table.encode(texts) == [texts[0].encode(), b"wordE, Word's. 'tis.'"]
    assert asked[" word"] == 1
    assert not [x for x in asked if x.startswith(" word") and x != " word"]


def test_plain_words_go_straight_to_the_model():
    e = huffman.Encoder(PATH)
    texts = [" plain Wörter çà zqxjkvw"]
    want = [np.array(e.library.encode(t, add_special_tokens=False).ids, e.dtype).tobytes() for t in texts]
    asked = []
    e.library = types.SimpleNamespace(encode_batch_fast=lambda texts, **_: asked.extend(texts) or [])
    assert e.table.encode(texts) == want
    assert not asked


@given(st.lists(st.text(alphabet="ab X.,'#%\"é\u01c5ʰ日7\n\t\x1f\xa0\u2003\U0001f600<|>", max_size=60) | st.sampled_from(["", "a<|endoftext|>  b", "<|endoftext|>", "a  \n", "x\n\n\ny  ", "it's.' '' ''s"]), max_size=8))
@settings(max_examples=60, deadline=None)
def test_encoders_equal_library_over_generations(library, texts):
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for make, dtype in ((huffman.encoder(PATH).table, huffman.encoder(PATH).dtype), (bpe.load(PATH)[1], bpe.load(PATH)[0].dtype)):
        table = ChunkTable(make.encode_chunks, make.added, 6)
        for part in (texts, texts[::-1], texts):
            assert [np.frombuffer(x, dtype).tolist() for x in table.encode(pa.array(part, pa.string()))] == [library.encode(t, add_special_tokens=False).ids for t in part]
        assert [np.frombuffer(x, dtype).tolist() for x in make.encode(texts)] == want
