"""Words of many texts at once, as numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """The words of a batch of texts: their numbers in the dictionary, the places of their bytes, and how many each text has.

    start and end are bytes within the own text; data has the bytes of all texts and base where each text begins there.
    """

    ids: np.ndarray
    dictionary: pa.Array
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    data: np.ndarray
    base: np.ndarray


def words_of(texts: pa.Array, in_word: np.ndarray, folded: np.ndarray | None = None) -> Words:
    """Stretches of bytes of the table in_word; folded maps bytes first. A null text has no words."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = in_word[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's first byte continues no word of the text before
    begins[first] = inside[first]
    ends = inside[:-1] & ~inside[1:]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    own = data[inside[:-1]] if folded is None else folded[data[inside[:-1]]]
    bounds = np.concatenate([[0], np.cumsum(end - start)])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(own))]).dictionary_encode()
    counts = np.diff(np.searchsorted(start, offsets))
    base = np.repeat(offsets[:-1], counts)
    return Words(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary, start - base, end - base, counts, data, offsets[:-1])
