"""A file of token ids, coded by a static range asymmetric numeral system (rANS), and its parallel decoding.

One file holds the ids of consecutive documents. Layout, little-endian:

    magic "PMTOK1\\0\\0"
    table     zlib: uint32 count of symbols, their ids as uint32 deltas, their frequencies as uint32 (they sum to 2**TABLE_BITS)
    blocks    each: uint64 state of each lane, then uint32 words; blocks share the table and decode independently
    documents zlib: int64 doc_id of each document, uint8 whether it is null, int64 number of ids of each
    checkpoints  zlib: for each block uint64 byte offset, uint32 byte length, uint32 ids, uint64 ids before it, uint32 crc32 of its ids
    footer    six uint64: offset and length of table, documents and checkpoints; uint32 crc32 of the three; magic

Lanes are interleaved: id i of a block belongs to lane i mod LANES, and all lanes advance together in numpy. A state is in
[2**31, 2**63) and gives or takes one 32-bit word at a time.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"PMTOK1\0\0"
TABLE_BITS = 18
LANES = 2048
BLOCK_IDS = 1 << 19
LOW = np.uint64(1 << 31)


def quantised(counts: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 where the count is positive."""
    total, out = 1 << bits, np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if not len(used):
        return out
    if len(used) > total:
        raise ValueError(f"{len(used)} symbols don't fit a table of {total}")
    spare = total - len(used)
    share = counts[used] * (spare / counts[used].sum())
    out[used] = 1 + np.floor(share).astype(np.int64)
    left = total - int(out.sum())
    out[used[np.argsort(-(share - np.floor(share)), kind="stable")[:left]]] += 1
    return out


def encode_block(ids: np.ndarray, table: Table, bits: int = TABLE_BITS) -> bytes:
    lanes = min(LANES, len(ids))
    if not lanes:
        return b""
    state, words = np.full(lanes, LOW, np.uint64), []
    freq, start = table.freq[ids], table.start[ids]
    room, most, low32 = np.uint64(1 << bits) - freq, freq << np.uint64(63 - bits), np.uint64(32)
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        some = slice(at, at + lanes)
        f = freq[some]
        x = state[: len(f)]
        over = np.flatnonzero(x >= most[some])
        if len(over):
            y = x[over]
            words.append(y.astype(np.uint32))
            x[over] = y >> low32
        q = x // f  # the new state is (q << bits) + x - q * f + start
        q *= room[some]
        x += q
        x += start[some]
    return state.astype("<u8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, table: Table, bits: int = TABLE_BITS) -> np.ndarray:
    lanes = min(LANES, n)
    slots = np.empty(n, np.uint64)
    if not lanes:
        return slots.astype(np.uint32)
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words, at = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64), 0
    mask, shift, low32, half = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32), np.uint64(0xFFFFFFFF)
    for k in range(0, n, lanes):
        x = state[: min(lanes, n - k)]
        slot = slots[k : k + len(x)]
        np.bitwise_and(x, mask, out=slot)
        step = table.steps[slot]
        x >>= shift
        x *= step >> low32
        x += step & half
        under = np.flatnonzero(x < LOW)
        if len(under):
            x[under] = (x[under] << low32) | words[at : at + len(under)]
            at += len(under)
    if at != len(words) or (state != LOW).any():
        raise ValueError("a block doesn't end in its first state")
    return table.symbol[slots]


class Table:
    def __init__(self, ids: np.ndarray, freqs: np.ndarray, bits: int = TABLE_BITS):
        size = int(ids.max()) + 1 if len(ids) else 0
        self.ids, self.freqs = ids, freqs
        self.freq = np.zeros(size, np.uint64)
        self.freq[ids] = freqs
        self.start = np.zeros(size, np.uint64)
        self.start[ids] = np.cumsum(freqs) - freqs

    @functools.cached_property
    def symbol(self) -> np.ndarray:
        """The id of each slot."""
        return np.repeat(self.ids, self.freqs).astype(np.uint32)

    @functools.cached_property
    def steps(self) -> np.ndarray:
        """For each slot its id's frequency, in the high half, and the slot's place among the id's."""
        f = np.repeat(self.freqs, self.freqs).astype(np.uint64)
        first = np.repeat(np.cumsum(self.freqs) - self.freqs, self.freqs).astype(np.uint64)
        return (f << np.uint64(32)) | (np.arange(len(f), dtype=np.uint64) - first)

    def pack(self) -> bytes:
        return zlib.compress(struct.pack("<I", len(self.ids)) + np.diff(self.ids, prepend=0).astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        raw = zlib.decompress(data)
        (n,) = struct.unpack_from("<I", raw)
        ids, freqs = np.frombuffer(raw, "<u4", n, 4).astype(np.int64), np.frombuffer(raw, "<u4", n, 4 + 4 * n).astype(np.int64)
        return cls(np.cumsum(ids), freqs)


def pack_file(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], write, block_ids: int = BLOCK_IDS) -> None:
    """Write one file's bytes by calls of write(bytes). ids: of all its documents, one after the other."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    freq = quantised(counts)
    used = np.flatnonzero(freq)
    t = Table(used, freq[used])
    packed = t.pack()
    write(MAGIC + packed)
    at, marks = len(MAGIC) + len(packed), []
    for k in range(0, len(ids), block_ids):
        block = ids[k : k + block_ids]
        data = encode_block(block, t)
        write(data)
        marks.append((at, len(data), len(block), k, zlib.crc32(block.astype("<u4", copy=False))))
        at += len(data)
    docs = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(lengths, "<i8").tobytes())
    index = zlib.compress(b"".join(struct.pack("<QIIQI", *m) for m in marks))
    foot = struct.pack("<6Q", len(MAGIC), len(packed), at, len(docs), at + len(docs), len(index))
    write(docs + index + foot + struct.pack("<I", zlib.crc32(packed + docs + index + foot)) + MAGIC)


FOOT = 48 + 4 + len(MAGIC)


class Reader:
    """Reads a file by read_at(offset, length); decodes any block alone."""

    def __init__(self, read_at, size: int):
        foot = read_at(size - FOOT, FOOT)
        if foot[-len(MAGIC) :] != MAGIC or read_at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        t, tn, d, dn, c, cn = struct.unpack_from("<6Q", foot)
        table, docs, index = read_at(t, tn), read_at(d, dn), read_at(c, cn)
        if zlib.crc32(table + docs + index + foot[:48]) != struct.unpack_from("<I", foot, 48)[0]:
            raise ValueError("the tables' checksum is wrong")
        self.read_at, self.table = read_at, Table.unpack(table)
        raw = zlib.decompress(docs)
        n = len(raw) // 17
        null = raw[8 * n : 9 * n]
        self.doc_ids = [None if z else int(x) for x, z in zip(np.frombuffer(raw, "<i8", n), null, strict=True)]
        self.lengths = np.frombuffer(raw, "<i8", n, 9 * n)
        self.checkpoints = list(struct.iter_unpack("<QIIQI", zlib.decompress(index)))

    def block(self, k: int) -> np.ndarray:
        at, length, n, _, crc = self.checkpoints[k]
        ids = decode_block(self.read_at(at, length), n, self.table)
        if zlib.crc32(ids.astype("<u4", copy=False)) != crc:
            raise ValueError(f"block {k}: the ids' checksum is wrong")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of each document, in order; one block and one document in memory."""
        have, k = np.zeros(0, np.uint32), 0
        for doc, n in zip(self.doc_ids, self.lengths, strict=True):
            parts, size = [have], len(have)
            while size < n:
                parts.append(self.block(k))
                k, size = k + 1, size + len(parts[-1])
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield doc, have[:n]
            have = have[n:]
