"""Substring deduplication by super-k-mer partitioning.

A window is WINDOW consecutive words. Of the MINIMISER-word runs inside a window the one of least hash is its minimiser;
consecutive windows that share it travel as one string of words, a super-k-mer, to the bucket of that hash. Equal windows have
equal minimisers, so each bucket holds all occurrences of its windows: it sorts them, checks equality word by word, and finds
for each the smallest document. Before the shuffle a task packs the super-k-mers of a bucket together, each string once with
the places where it stands, and compresses them, so a passage that many documents share travels once a task.

Defined cases: a null text has no words; a null doc_id counts as larger than all others (rows without one never come first
for each other); rows that share an id don't remove from each other; repeated rows are judged alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise, trim

WINDOW, MINIMISER = 13, 3
#: Text bytes for each bucket (its super-k-mers are about three times as long), and packed bytes a task holds.
BUCKET_BYTES, HELD_BYTES = 3 << 20, 24 << 20
REMEMBERED = 1 << 17
#: Removed runs (16 bytes each, and some 100 for each document) up to which they are broadcast rather than shuffled.
BROADCAST_RUNS = 1_000_000
NO_ID = (1 << 63) - 1
_P = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def minimisers(hashes: np.ndarray, window: int = WINDOW, run: int = MINIMISER) -> np.ndarray:
    """The least hash of a run of words inside each window."""
    h = np.zeros(len(hashes) - run + 1, np.uint64)
    for k in range(run):
        h = mixed(h * _P + hashes[k : len(hashes) - run + 1 + k])
    width, have = window - run + 1, 1
    while 2 * have <= width:
        h, have = np.minimum(h[:-have], h[have:]), 2 * have
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if width > have else h


class Packer:
    """Collects the super-k-mers of documents by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.known, self.size = buckets, {}, 0
        self.held: dict[int, tuple[dict[bytes, int], array]] = {}

    def add(self, oid: int, key: int, words: list[bytes]) -> None:
        if len(words) < WINDOW:
            return
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        least = minimisers(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        cuts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        ends = np.append(cuts[1:], len(least)) + WINDOW - 1
        places = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        line = b" ".join(words)
        begins = np.where(cuts > 0, places[cuts - 1], 0).tolist()
        for bucket, first, a, b in zip((least[cuts] % np.uint64(self.buckets)).tolist(), cuts.tolist(), begins, (places[ends - 1] - 1).tolist(), strict=True):
            if (held := self.held.get(bucket)) is None:
                held = self.held[bucket] = ({}, array("q"))
            strings, marks = held
            s = line[a:b]
            n = strings.setdefault(s, len(strings))
            if n == len(strings) - 1:
                self.size += b - a
            marks.extend((n, oid, key, first))
            self.size += 32

    def packed(self) -> pd.DataFrame:
        z = zstd.ZstdCompressor(level=3)
        rows = [(k, z.compress(b"\n".join(strings)), z.compress(np.frombuffer(marks, "<i8").reshape(-1, 4).T.tobytes())) for k, (strings, marks) in self.held.items()]
        self.held, self.size = {}, 0
        return pd.DataFrame(rows, columns=["bucket", "strings", "places"])


def equal_groups(ids: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A group number for each window of ids that begins at starts: equal for windows of equal words, and only for those."""
    h = np.zeros(len(ids) - window + 1, np.uint64)
    for k in range(window):
        h = h * _P + ids[k : len(ids) - window + 1 + k].astype(np.uint64)
    h = mixed(h)[starts]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    a, b = starts[order[:-1][same]], starts[order[1:][same]]
    if any((ids[a + k] != ids[b + k]).any() for k in range(window)):  # hashes that collide: sort the words themselves
        return np.unique(np.stack([ids[starts + k] for k in range(window)], axis=1), axis=0, return_inverse=True)[1].ravel()
    out = np.empty(len(starts), np.int32)
    out[order] = np.concatenate(([0], np.cumsum(~same)))
    return out


RUNS = "oid bigint, tkey bigint, first bigint, last bigint"


def removed(strings: list[bytes], places: np.ndarray, window: int = WINDOW) -> pd.DataFrame:
    """Runs of words to remove; places: string, oid, tkey, first word of each super-k-mer."""
    lengths = np.array([s.count(b" ") + 1 for s in strings])
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(s.split(b" ") for s in strings)), np.int32, int(lengths.sum()))
    del number
    windows = lengths - window + 1
    begin = np.cumsum(windows) - windows
    starts = np.arange(int(windows.sum())) + np.repeat((np.cumsum(lengths) - lengths) - begin, windows)
    group = equal_groups(ids, starts, window)
    owner, oid, key, first = places
    least_of = np.full(len(strings), NO_ID)
    np.minimum.at(least_of, owner, oid)
    least = np.full(int(group.max()) + 1, NO_ID)
    np.minimum.at(least, group, np.repeat(least_of, windows))
    n = windows[owner]
    occurrence = np.repeat(np.arange(len(owner)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    late = np.flatnonzero(oid[occurrence] > least[group[begin[owner][occurrence] + inside]])
    if not len(late):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("oid", "tkey", "first", "last")})
    occurrence, at = occurrence[late], inside[late] + first[occurrence[late]]
    new = np.concatenate(([True], (occurrence[1:] != occurrence[:-1]) | (at[1:] != at[:-1] + 1)))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    return pd.DataFrame({"oid": oid[occurrence[heads]], "tkey": key[occurrence[heads]], "first": at[heads], "last": at[tails] + window})


def covered(docs: DataFrame) -> DataFrame:
    """Runs of words to remove from docs (oid, tkey, text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, -(-size // BUCKET_BYTES)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(buckets)
        for batch in batches:
            for oid, key, text in zip(batch["oid"], batch["tkey"], batch["text"], strict=True):
                packer.add(int(oid), int(key), split(text))
                if packer.size >= HELD_BYTES:
                    yield packer.packed()
        if packer.size:
            yield packer.packed()
        trim()

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        places = []
        z = zstd.ZstdDecompressor()
        for s, p in zip(rows["strings"], rows["places"], strict=True):
            at = np.array([number.setdefault(x, len(number)) for x in z.decompress(s).split(b"\n")])
            some = np.frombuffer(z.decompress(p), "<i8").reshape(4, -1).copy()
            some[0] = at[some[0]]
            places.append(some)
        return removed(list(number), np.concatenate(places, axis=1))

    packed = docs.where("text is not null").mapInPandas(pack, "bucket bigint, strings binary, places binary")
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(judge, RUNS)


def joined(runs: Column) -> Column:
    """Sorted runs (first, last), those that touch joined."""

    def step(a: Column, r: Column) -> Column:
        top = F.element_at(a, -1)
        grown = F.array_append(F.slice(a, 1, F.size(a) - 1), F.struct(top["first"].alias("first"), F.greatest(top["last"], r["last"]).alias("last")))
        return F.when(F.element_at(a, -1)["last"] >= r["first"], grown).otherwise(F.array_append(a, r))

    return F.aggregate(F.slice(runs, 2, 1 << 30), F.slice(runs, 1, 1), step)


KEPT = "n_words bigint, n_removed bigint, kept string"


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id of each row of docs with n_words, n_removed and kept, its kept words joined by one space."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("oid"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "text")
    runs = covered(rows.select("oid", "tkey", "text")).groupBy("oid", "tkey").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    runs = materialise(runs.select("oid", "tkey", joined(F.array_sort("runs")).alias("runs")), "runs")
    size = runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    runs = F.broadcast(runs) if size <= BROADCAST_RUNS else runs

    @F.pandas_udf(KEPT)
    def keep(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in parts:
            out = []
            for text, some in zip(texts, gone, strict=True):
                words = split(text)
                n, at, kept = len(words), 0, []
                for r in sorted((r["first"], r["last"]) for r in some) if some is not None else ():
                    kept += words[at : r[0]]
                    at = max(at, r[1])
                kept += words[at:]
                out.append((n, n - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    found = rows.join(runs, ["oid", "tkey"], "left").select("doc_id", keep.asNondeterministic()("text", "runs").alias("k"))
    return found.select("doc_id", "k.*")
