"""Words of many texts at once: Arrow splits and numbers them, so Python handles distinct words only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are split together; a longer text goes alone.
SLICE_BYTES = 4 << 20


def texts_of(column: pa.Array, rows: int = 4096, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """First row, end row, bytes and offsets of slices of a column of strings, none of which is null."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, at = column.buffers()[2], 0
    while at < len(column):
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1), len(column))
        some = ends[at : end + 1]
        yield at, end, data.slice(int(some[0]), int(some[-1] - some[0])).to_pybytes() if data is not None else b"", some - some[0]
        at = end


def numbered(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row and number of each word, in order, and the distinct words; words are what ASCII white space parts."""
    n = len(offsets) - 1
    texts = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    rows = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in words:  # of empty texts and of white space at an end
        some = codes != words.index(b"")
        rows, codes = rows[some], codes[some]
    return rows, codes.astype(np.int64), words


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
