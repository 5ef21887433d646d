"""Words, shingles and token ids of Arrow columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import plain_shingles, plain_words

from rankflow.llm import text_arrays, tokens

PARTS = [
    " ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "É", "1", "23", ".", ",", "!", "'s", "'", " ", "　",
    "漢字", "😀", "don't", "\x1c", "- ", "_", "\r\n", "\x00", "ß", "²", "٣", "\x85", "word", " word", ".\nNext",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(4000)]
    return [*made, "", None, " ", "x" * 3_000_000, "word " * 300_000]


def test_words_and_shingles_are_those_of_each_row(texts):
    found = text_arrays.words(pa.array(texts, pa.string()))
    assert np.diff(found.offsets).tolist() == [len(plain_words(t)) for t in texts]
    seen = {}
    for i, text in enumerate(texts):
        for word, h in zip(plain_words(text), found.hashes[found.offsets[i] : found.offsets[i + 1]].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    values, offsets = text_arrays.shingles(found, 5)
    for i, text in enumerate(texts):
        assert len(np.unique(values[offsets[i] : offsets[i + 1]])) == len(plain_shingles(text))


def test_slices_hold_all_rows_in_order(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = list(text_arrays.slices(batch, "text", 1000))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts
    assert len(parts) > 10


def test_blocks_hold_all_rows_in_order(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = [batch.slice(i, 7) for i in range(0, len(texts), 7)]
    joined = list(text_arrays.blocks(iter(parts), "text", 5000))
    assert [x for p in joined for x in p.column("text").to_pylist()] == texts
    assert 1 < len(joined) < len(parts)
    assert list(text_arrays.blocks(iter([]), "text", 10)) == []


def test_ids_are_the_library_s_own(texts):
    path = tokens.default_tokenizer()
    ids, offsets = tokens.encode(pa.array(texts, pa.string()), path, 0)
    for i, text in enumerate(texts):
        if text is None or len(text) < 1000:
            own = tokens._tokenizer(path).encode(text or "", add_special_tokens=False).ids
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*own, 0]
    none, at = tokens.encode(pa.array([], pa.string()), path, 0)
    assert len(none) == 0 and at.tolist() == [0]
    assert tokens.encode(pa.array([None, ""], pa.string()), path, 7)[0].tolist() == [7, 7]
