"""Words of whole Arrow text columns, numbered without a Python object for each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, true for the bytes of the inclusive ``ranges``."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


@dataclass
class Words:
    """All words of a column of texts, in order.

    ``names``: the distinct words (Arrow binary); ``code``: each word's place in
    ``names``; ``doc``: its row; ``first``: where each row's words begin, and at
    last their number; ``start``, ``end``: its bytes in ``raw``, the texts A-Z lower-cased.
    """
    names: object
    code: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: np.ndarray


def split(column, gap: np.ndarray) -> Words:
    """Words of a string column (null: empty) between the bytes of ``gap``; no word spans two rows."""
    import pyarrow as pa
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = _LOWER[np.frombuffer(data, np.uint8)[off[0]:off[-1]]] if data is not None else np.empty(0, np.uint8)
    off = off - off[0]
    between = gap[raw]
    mark = np.zeros(len(raw) + 1, bool)
    mark[1:-1] = between[1:] != between[:-1]
    mark[off] = True
    mark[0] = mark[-1] = True
    cuts = np.flatnonzero(mark)
    word = ~between[cuts[:-1]]
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])
    coded = every.filter(pa.array(word)).dictionary_encode()
    start, end = cuts[:-1][word], cuts[1:][word]
    first = np.searchsorted(start, off, "left")
    return Words(coded.dictionary, coded.indices.to_numpy(), np.searchsorted(off, start, "right") - 1, first, start, end, raw)
