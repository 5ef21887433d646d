"""Token ids of whole Arrow text columns by a public tokenizer.

A byte-level BPE never merges across the pieces its pre-tokenizer cuts, so equal pieces always get
equal ids. Texts are cut at places where the pre-tokenizer is sure to cut as well, the distinct
pieces of a few MB of text are encoded once by the ``tokenizers`` library, and ids are gathered
from there. A test holds the ids against the library's own on whole texts.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa

from rankflow.llm.text_arrays import flat_bytes

#: Bytes of text whose pieces are looked up together; work arrays take about 45 times as much.
SLICE_BYTES = 3 << 20
#: Pieces that are put together for one call of the library.
_JOINED = 500

# Kinds of bytes: ASCII letters and digits; ASCII other than white space and controls; first bytes of
# characters that can't be white space; stops.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_SOLID = _ASCII.copy()
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _token_bytes(path: str) -> np.ndarray:
    """Bytes of every token; the vocabulary writes one character for each."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int32)
    out[list(vocabulary.values())] = [len(t) for t in vocabulary]
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where every text is sure to be cut.

    Before a space that is followed by something other than white space; before and after a single
    line end between such characters; before a stop after an ASCII letter or digit.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        solid, here = _SOLID[data], data[:-1]
        cut[:-2] |= (here == 32) & solid[1:]
        line = np.zeros(len(data), bool)
        line[1:-1] = (data[1:-1] == 10) & _ASCII[data[:-2]] & solid[2:]
        cut[:-1] |= line
        cut[1:] |= line
        cut[1:-1] |= _WORD[here] & _STOP[data[1:]]
    cut[offsets] = True
    cut[-1] = False
    return np.flatnonzero(cut)


def _ids_of(pieces: pa.LargeStringArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct pieces, end to end, and the number of ids of each."""
    data, offsets = flat_bytes(pieces)
    first = data[offsets[:-1]]
    second = data[np.minimum(offsets[:-1] + 1, len(data) - 1)]
    # A cut before a space is sure whatever stands before it, so such pieces may be joined.
    joins = (first == 32) & _SOLID[second] & (np.diff(offsets) > 1)
    own = np.flatnonzero(~joins)
    coded = _tokenizer(path).encode_batch_fast(pieces.take(pa.array(own)).to_pylist(), add_special_tokens=False)
    size = np.zeros(len(pieces), np.int32)
    size[own] = [len(e.ids) for e in coded]
    own_ids = [e.ids for e in coded]
    other = np.flatnonzero(joins)
    data, offsets = flat_bytes(pieces.take(pa.array(other)))
    raw = data.tobytes()
    at = offsets[::_JOINED].tolist() + ([len(raw)] if len(other) % _JOINED or not len(other) else [])
    texts = [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    coded = _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)
    joined = np.concatenate([np.array(e.ids, np.uint32) for e in coded] or [np.zeros(0, np.uint32)])
    ends = np.cumsum(_token_bytes(path)[joined])
    last = np.searchsorted(ends, offsets)  # tokens that end at or before each piece's start
    last[1:] += 1
    size[other] = np.diff(last)
    pool = np.empty(size.sum(), np.uint32)
    is_joined = np.repeat(joins, size)
    pool[is_joined] = joined
    pool[~is_joined] = np.concatenate([np.array(x, np.uint32) for x in own_ids] or [np.zeros(0, np.uint32)])
    return pool, size


def encode(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and row offsets; ``end_id`` is added to every row. A null is an empty text."""
    data, offsets = flat_bytes(texts)
    rows = len(offsets) - 1
    extra = int(end_id is not None)
    if not len(data):
        return np.full(rows * extra, end_id or 0, np.uint32), np.arange(rows + 1) * extra
    starts = piece_starts(data, offsets)
    pieces = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(np.ascontiguousarray(data))
    ).dictionary_encode()
    pool, size = _ids_of(pieces.dictionary, path)
    which = pieces.indices.to_numpy(zero_copy_only=False)
    n = size[which]
    total = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    first_piece = np.searchsorted(starts, offsets)
    row_offsets = total[first_piece] + np.arange(rows + 1) * extra
    begin = (np.cumsum(size) - size).astype(np.int64)
    source = np.repeat((begin[which] - total[:-1]).astype(np.int32), n)
    source += np.arange(total[-1], dtype=np.int32)
    ids = pool[source]
    if not extra:
        return ids, row_offsets
    return np.insert(ids, total[first_piece[1:]], end_id), row_offsets
