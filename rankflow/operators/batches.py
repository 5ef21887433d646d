"""Arrow batches of index rows as flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def known_postings(
    terms: pa.ListArray, vocabulary: pa.StringArray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the batch, position in the vocabulary and frequency of every known term."""
    flat = pc.list_flatten(terms)
    found = pc.index_in(pc.struct_field(flat, "term"), value_set=vocabulary)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    doc = pc.list_parent_indices(terms).to_numpy()[known]
    term = found.drop_null().to_numpy().astype(np.int64)
    return doc, term, pc.struct_field(flat, "tf").to_numpy()[known]


def whole_documents(sizes: np.ndarray, docs: np.ndarray, limit: int) -> Iterator[slice]:
    """Cut postings, ordered by document, into runs of whole documents of about ``limit``."""
    if not len(sizes):
        return
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    part = np.add.reduceat(sizes, first).cumsum() // limit
    cuts = first[np.r_[True, part[1:] != part[:-1]]]
    for start, end in zip(cuts, np.r_[cuts[1:], len(sizes)]):
        yield slice(start, end)


def posting_slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch of index rows into runs of rows with about ``limit`` postings; a longer row stands alone."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
