"""Exact top-k search: BM25 by block-max pruning on an inverted index, shard by shard, merged exactly by global statistics.

One pass writes the index: each task packs its documents, in an order that brings like ones together, into shards of about
SHARD_DOCS, with terms, their postings in order of documents, and lengths, one file each in the shared folder. A shard's
terms are counted from its file; sums over all shards give the global document frequencies and mean length, by which every
shard scores alike, so the merge is exact. Queries are packed in batches of up to BATCH with their terms' idf.

Shards are searched in rounds of 1, 15, 240, ... shards for each batch, in an order of the batch's own. A round's results are
merged by batch, and the k-th score so far is the floor of the next round; so the rows that a round makes stay in proportion
to the queries. In a shard, a query whose summed term maxima stay under its floor is skipped whole. Where the sum is near
the floor (up to PIVOTAL times), blocks of BLOCK documents are pivots if their summed block maxima reach the floor, and only
pivots are scored. Other queries, for which block maxima can't exclude blocks, are scored by all their postings: terms that
COMMON of a shard's documents hold as rows of a matrix, a batch at a time, the others list by list. What then reaches the
floor is scored again in double precision, terms in one global order, so equal documents have equal scores everywhere.

Terms are known by 63 bits of XXH3; two words with equal hashes would count as one (one chance in 10^7 for 10^6 words).

Defined cases: null or word-less texts match nothing and ask nothing; rows without doc_id are neither indexed nor asked;
repeated rows are documents of their own and one query; rows with one id and different texts are queries of their own under
that id; equal scores (to six places) are in order of doc_id; a query that matches fewer than k documents gets those; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise, scratch_path, trim
from pagemill.llm.decontaminate import _FOLD
from pagemill.llm.files import load, open_fs, save, task_file
from pagemill.llm.words import hashed, numbered, texts_of

K1, B = 1.2, 0.75
TOP = 10
#: Documents of a shard, and postings (some 22 bytes each when searched) at which it ends before.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 8_000_000
#: A small table is cut into as many shards as there are cores, if they have so many documents.
LEAST_DOCS = 1 << 11
#: Queries of a batch, and terms of all of them at which it ends before.
BATCH, BATCH_TERMS = 512, 1_000_000
BLOCK, PIVOTAL = 64, 1.5
#: Terms that are rows of a matrix; of single precision, so its sums are off by at most SLACK of themselves.
COMMON, MOST_COMMON, SLACK = 0.08, 1024, 5e-5
#: Numbers of a matrix at most; lists that are gathered for all queries at once; share of the floor under which terms of long lists must stay.
DENSE, SHORT, FAR = 12_000_000, 96, 0.6
#: Each round takes so many times the shards of all rounds before it.
GROWTH = 16

#: The layout: texts of its sample and characters of each, common words that it goes by, means, their likeness from which they are joined, bands of length.
SAMPLE, SAMPLE_CHARS, FEATURES, MEANS, LIKE, BANDS = 2000, 20_000, 512, 8, 0.7, 6
#: Texts of which words are numbered together.
SLICE_ROWS = 4096

BAG = "part int, digest binary, ids binary, n bigint, size bigint, term binary, tf binary"
BAG_NAMES = ["part", "digest", "ids", "n", "size", "term", "tf"]
BAG_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
MANIFEST = "path string, label bigint, docs bigint, words bigint"
PACK = "batch bigint, query binary, asks binary, starts binary, term binary, terms binary"
#: One number of 8 bytes, so that lists are gathered by one copy; impacts are of single precision, and bounds made of them are widened by NEAR.
POSTING, NEAR = np.dtype([("doc", "<i4"), ("impact", "<f4")]), 1 + 1e-6
FOUND = np.dtype([("q", "<i4"), ("doc", "<i8"), ("score", "<f8")])


def runs(change: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end; change: whether a value differs from the one before."""
    return np.append(np.flatnonzero(np.concatenate(([True], change))), len(change) + 1)


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and which range each is of."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) + (first - (np.cumsum(n) - n))[which], which


def counted(column: pa.Array, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a column of texts: first row, end row, and row, hashed term and count of each distinct term of a text."""
    for at, end, data, offsets in texts_of(column, rows):
        row, code, words = numbered(data.translate(_FOLD), offsets)
        key, n = np.unique(row * max(1, len(words)) + code, return_counts=True)
        row, code = np.divmod(key, max(1, len(words)))
        yield at, end, row, (hashed(words) >> np.uint64(1)).astype(np.int64)[code], n.astype(np.int32)


class Layout:
    """How texts are dealt out: by likeness of their common words, then by length. It bears on the time only, not on results.

    Fitted on a sample of texts: means of their common words (spherical, MEANS at most, like ones joined), and for each mean
    thresholds of distinct words that cut the sample into bands of equal work.
    """

    def __init__(self, column: pa.Array | None, parts: int):
        self.terms, self.means, self.cuts = np.zeros(0, np.int64), np.zeros((1, 0)), [np.zeros(0)]
        self.at, self.each = [0], [1]
        if column is None or parts < 2:
            return
        found = [(row + at, term, tf) for at, _, row, term, tf in counted(column, len(column))]
        row, term, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(row):
            return
        terms, code, df = np.unique(term, return_inverse=True, return_counts=True)
        common = np.sort(np.argsort(-df, kind="stable")[:FEATURES])
        self.terms = terms[common]
        x = np.zeros((len(column), len(common)))
        where = np.searchsorted(common, code)
        some = common[np.minimum(where, len(common) - 1)] == code
        x[row[some], where[some]] = np.sqrt(tf[some])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        means = x[[int(np.argmax(x.sum(axis=1)))]]
        while len(means) < MEANS:
            means = np.vstack([means, x[np.argmin(np.where(x.any(axis=1), (x @ means.T).max(axis=1), 2))]])
        for _ in range(10):
            near = (x @ means.T).argmax(axis=1)
            sums = np.array([x[near == k].sum(axis=0) for k in range(len(means))])
            means = sums[sums.any(axis=1)]
            means /= np.linalg.norm(means, axis=1, keepdims=True)
        joined: list[np.ndarray] = []
        for k in np.argsort(-np.bincount((x @ means.T).argmax(axis=1), minlength=len(means)), kind="stable"):
            if not joined or (np.array(joined) @ means[k]).max() < LIKE:
                joined.append(means[k])
        self.means = np.array(joined)
        distinct = np.bincount(row, minlength=len(column))
        label, work = self.labels(row, term, tf, len(column)), distinct + 100.0
        self.at, self.each, self.cuts = [], [], []
        at = 0
        for k in range(len(joined)):
            own = np.flatnonzero(label == k)
            own = own[np.argsort(distinct[own], kind="stable")]
            n = max(1, round(parts * work[own].sum() / work.sum()))
            bands = max(1, min(n, BANDS, len(own) // 50))
            upto = np.cumsum(work[own])
            self.cuts.append(distinct[own][np.searchsorted(upto, upto[-1] * np.arange(1, bands) / bands)] if bands > 1 else np.zeros(0))
            self.at.append(at)
            self.each.append(-(-n // bands))
            at += bands * self.each[-1]

    @property
    def parts(self) -> int:
        return self.at[-1] + (len(self.cuts[-1]) + 1) * self.each[-1]

    def labels(self, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        if len(self.means) < 2:
            return np.zeros(n, np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        some = np.flatnonzero(self.terms[at] == term)
        row, at, x = row[some], at[some], np.sqrt(tf[some])
        return np.array([np.bincount(row, x * mean[at], n) for mean in self.means]).argmax(axis=0)

    def part(self, label: int, distinct: int, draw: int) -> int:
        return self.at[label] + int(np.searchsorted(self.cuts[label], distinct, side="right")) * self.each[label] + draw % self.each[label]

    def label_of(self, part: int) -> int:
        return int(np.searchsorted(self.at, part, side="right")) - 1


def laid_out(docs: DataFrame, rows: int, parts: int) -> Layout:
    """Fitted on some SAMPLE texts, of each the first SAMPLE_CHARS characters."""
    if parts < 2:
        return Layout(None, parts)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rows)) < SAMPLE).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE)
    texts = sorted(r.text for r in some.collect())
    return Layout(pa.array(texts, pa.string()) if texts else None, parts)


def tokenised(docs: DataFrame, layout: Layout, by_length: bool, keep: int | None) -> DataFrame:
    """Bags of words of docs (doc_id, text), dealt to the layout's parts and sorted by digest.

    Texts of the same words have one digest. A task sends their words once and their ids (keep: the least of them) together.
    """
    parts = layout.parts if by_length else len(layout.at)

    def least(ids: list[int]) -> bytes:
        return np.sort(np.array(ids, np.int64))[:keep].tobytes()

    def rows(values: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values, strict=True), BAG_TYPES, strict=True)], BAG_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: dict[bytes, list] = {}  # by digest: part, size, ids beyond the first, their number
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, end, row, term, tf in counted(batch.column(1), SLICE_ROWS):
                by = np.lexsort((term, row))
                row, term, tf = row[by], term[by], tf[by]
                label = layout.labels(row, term, tf, end - at)
                size = np.bincount(row, tf, end - at).astype(np.int64).tolist()
                ends = np.searchsorted(row, np.arange(end - at + 1)).tolist()
                terms, tfs, out = term.tobytes(), tf.tobytes(), []
                for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                    if a == b:
                        continue
                    t, f = terms[8 * a : 8 * b], tfs[4 * a : 4 * b]
                    digest = xxhash.xxh3_128_digest(t + f)
                    if (held := more.get(digest)) is None:
                        part = layout.part(label[i], b - a, int.from_bytes(digest[:4])) if by_length else int(label[i])
                        more[digest] = held = [part, size[i], [], 0]
                        out.append((part, digest, ids[at + i].tobytes(), 1, size[i], t, f))
                    else:
                        held[2].append(int(ids[at + i]))
                        held[3] += 1
                        if keep and len(held[2]) > 64 + keep:
                            held[2] = sorted(held[2])[:keep]
                if out:
                    yield rows(out)
        again = [(part, digest, least(some), n, size, None, None) for digest, (part, size, some, n) in more.items() if n]
        for k in range(0, len(again), 4096):
            yield rows(again[k : k + 4096])
        trim()

    return docs.mapInArrow(run, BAG).repartitionById(parts, F.col("part")).sortWithinPartitions("digest")


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, int, bytes, bytes]]:
    """Ids, number of texts, words, terms and counts of each digest of a part."""
    last, ids, n, size, term, tf = None, [], 0, 0, b"", b""
    for batch in batches:
        for digest, some, m, s, t, f in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            if digest != last:
                if ids:
                    yield np.frombuffer(b"".join(ids), "<i8"), n, size, term, tf
                last, ids, n, size = digest, [], 0, s
            ids.append(some)
            n += m
            if t is not None:
                term, tf = t, f
    if ids:
        yield np.frombuffer(b"".join(ids), "<i8"), n, size, term, tf


def indexed(bagged: DataFrame, layout: Layout, top: int) -> DataFrame:
    """Writes the shards of bags of words; path, label, texts with words, and words of each."""
    folder = scratch_path(bagged.sparkSession, "index")
    most_docs, most_postings = SHARD_DOCS, SHARD_POSTINGS

    def written(held: list[tuple], k: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        ids, copies, sizes = [np.sort(h[0])[:top] for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held])
        term, tf = np.frombuffer(b"".join(h[3] for h in held), "<i8"), np.frombuffer(b"".join(h[4] for h in held), "<i4")
        counts = np.array([len(h[4]) // 4 for h in held])
        held.clear()
        last = np.cumsum(counts)
        first = last - counts
        # Like documents together: by the word of greatest count, then by the least hash of a word.
        often = np.minimum.reduceat(np.where(tf == np.repeat(np.maximum.reduceat(tf, first), counts), term, 1 << 62), first)
        by = np.lexsort(([x[0] for x in ids], np.minimum.reduceat(term, first), often))
        where, doc = ranges(first[by], last[by])
        term, tf, doc = term[where], tf[where], doc.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        del where
        order = np.argsort(term, kind="stable")
        term, doc, tf, ids, copies = term[order], doc[order], tf[order], [ids[d] for d in by], copies[by]
        ends = runs(np.diff(term) != 0)
        mass = np.add.reduceat(copies[doc], ends[:-1])
        path = task_file(folder, k, ".npz.zst")
        save(path, terms=term[ends[:-1]], df=np.diff(ends).astype(np.uint32), mass=mass, doc=doc, tf=tf, ids=np.concatenate(ids), held=np.array([len(x) for x in ids]), sizes=sizes[by])
        label = layout.label_of(TaskContext.get().partitionId())
        return pa.RecordBatch.from_pydict({"path": [path], "label": [label], "docs": [int(copies.sum())], "words": [int(copies @ sizes[by])]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, k = [], 0, 0
        for bag in bags(batches):
            held.append(bag)
            postings += len(bag[4]) // 4
            if 2 * len(held) >= 3 * most_docs or postings >= most_postings:
                yield written(held, k)
                postings, k = 0, k + 1
        if held:
            yield written(held, k)
        trim()

    return bagged.mapInArrow(run, MANIFEST)


def frequencies(shards: DataFrame) -> DataFrame:
    """term and df, over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = load(path)
                for at in range(0, len(found["terms"]), 1 << 18):
                    some = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_pydict({"term": found["terms"][some], "df": found["mass"][some]})

    return shards.select("path").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def packed(bagged: DataFrame) -> DataFrame:
    """Batches of queries, each of one label: ids and how many each has, where each one's terms begin, and its terms as places in the batch's sorted terms."""
    most, most_terms = BATCH, BATCH_TERMS

    def row(batch: int, held: list[tuple]) -> pa.RecordBatch:
        terms, term = np.unique(np.frombuffer(b"".join(h[3] for h in held), "<i8"), return_inverse=True)
        starts = np.append(0, np.cumsum([len(h[4]) // 4 for h in held]))
        values = {"batch": batch, "query": np.concatenate([h[0] for h in held]).tobytes(), "asks": np.array([len(h[0]) for h in held], "<i8").tobytes(), "starts": starts.astype("<i8").tobytes(), "term": term.astype("<i4").tobytes(), "terms": terms.tobytes()}
        held.clear()
        return pa.RecordBatch.from_pylist([values], pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("query", "asks", "starts", "term", "terms"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, terms, k = [], 0, TaskContext.get().partitionId() << 32
        for bag in bags(batches):
            n = len(bag[4]) // 4
            if held and (len(held) >= most or terms + n > most_terms):
                yield row(k, held)
                terms, k = 0, k + 1
            held.append(bag)
            terms += n
        if held:
            yield row(k, held)
        trim()

    return bagged.mapInArrow(run, PACK)


def weighted(packs: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """packs with idf: of each of a batch's terms, 0 for those of no document."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                term = np.frombuffer(terms, "<i8")
                yield pa.RecordBatch.from_pydict({"batch": np.full(len(term), number), "place": np.arange(len(term), dtype=np.int32), "term": term})

    def gathered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        place, count = rows["place"].to_numpy(), rows["df"].to_numpy(float)
        idf = np.zeros(int(place.max()) + 1)
        idf[place] = np.log(1 + (n - count + 0.5) / (count + 0.5))
        return pd.DataFrame({"batch": [key[0]], "idf": [idf.tobytes()]})

    # Spark takes what is read from a few paths for small; the hints keep it from broadcasting all terms.
    rows = packs.select("batch", "terms").mapInArrow(listed, "batch bigint, place int, term bigint").hint("merge").join(df, "term")
    return packs.hint("merge").join(rows.select("batch", "place", "df").groupBy("batch").applyInPandas(gathered, "batch bigint, idf binary"), "batch")


class Pack:
    """A batch of queries."""

    def __init__(self, values: dict):
        self.batch = values["batch"]
        self.starts, self.term, self.terms = np.frombuffer(values["starts"], "<i8"), np.frombuffer(values["term"], "<i4"), np.frombuffer(values["terms"], "<i8")
        self.n = len(self.starts) - 1
        self.idf = np.zeros(len(self.terms))
        idf = np.frombuffer(values["idf"], "<f8")
        self.idf[: len(idf)] = idf
        self.floor = np.zeros(self.n)
        if values.get("floor") is not None:
            floor = np.frombuffer(values["floor"], "<f8")
            self.floor[: len(floor)] = floor


def packs_of(path: str, wanted: Callable[[int], bool]) -> Iterator[Pack]:
    """The wanted batches of a table in the shared folder, one in memory at a time."""
    system, name = open_fs(path)
    for info in sorted(system.get_file_info(pafs.FileSelector(name)), key=lambda f: f.path):
        if info.is_file and info.base_name.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                file = pq.ParquetFile(f)
                for group in range(file.num_row_groups):
                    if any(map(wanted, file.read_row_group(group, columns=["batch"]).column(0).to_pylist())):
                        for batch in file.iter_batches(1, row_groups=[group]):
                            values = batch.to_pylist()[0]
                            if wanted(values["batch"]):
                                yield Pack(values)


class Index:
    """One shard. Impacts are multiplied by idf as soon as a batch has told it."""

    def __init__(self, mean: float, terms: np.ndarray, df: np.ndarray, mass: np.ndarray, doc: np.ndarray, tf: np.ndarray, ids: np.ndarray, held: np.ndarray, sizes: np.ndarray):
        self.terms, self.ids, self.n = terms, ids, len(sizes)
        self.ids_last = np.cumsum(held)
        self.ids_first = self.ids_last - held
        self.df = df.astype(np.int64)
        self.last = np.cumsum(self.df)
        self.first = self.last - self.df
        self.length = K1 * (1 - B + B * sizes / mean)
        self.postings = np.empty(len(doc), POSTING)
        self.doc, self.impact, self.lists = self.postings["doc"], self.postings["impact"], self.postings.view(np.int64)
        self.doc[:] = doc
        self.impact[:] = tf * (K1 + 1) / (tf + self.length[doc])
        self.most = np.maximum.reduceat(self.impact, self.first).astype(float)
        by_doc = np.argsort(doc, kind="stable")
        self.doc_term = np.repeat(np.arange(len(terms), dtype=np.int32), df)[by_doc]
        self.doc_tf = tf[by_doc]
        self.doc_last = np.cumsum(np.bincount(doc, minlength=self.n))
        self.doc_first = np.append(0, self.doc_last[:-1])
        self.weights, self.idf, self.own = np.zeros(len(terms)), np.zeros(len(terms)), np.zeros(self.n)
        common = np.flatnonzero(df >= max(2, COMMON * self.n))
        common = common[np.argsort(-self.df[common], kind="stable")[: max(64, min(MOST_COMMON, DENSE // self.n))]]
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for r, t in enumerate(common):
            some = slice(self.first[t], self.last[t])
            self.dense[r, self.doc[some]] = self.impact[some]
        self.blocks: tuple | None = None
        self.room = np.empty(1 << 16, np.int64)

    def weigh(self, term: np.ndarray, idf: np.ndarray) -> None:
        """Multiply what the terms have by their idf, if that is new."""
        new = np.flatnonzero((self.idf[term] == 0) & (idf > 0))
        upto = np.cumsum(self.df[term[new]])
        for k in np.split(new, np.searchsorted(upto, np.arange(1 << 19, int(upto[-1]) if len(upto) else 0, 1 << 19))):
            t, x = term[k], idf[k]
            where, which = ranges(self.first[t], self.last[t])
            impact = self.impact[where] * x[which]
            self.impact[where] = impact
            self.own += np.bincount(self.doc[where], impact, self.n)
            self.idf[t] = x
            self.most[t] *= x
            some = self.row[t] >= 0
            self.dense[self.row[t[some]]] *= x[some, None].astype(np.float32)

    def pivots(self, term: np.ndarray, idf: np.ndarray, floor: float) -> np.ndarray:
        """Blocks whose summed maxima reach the floor."""
        count = -(-self.n // BLOCK)
        if self.blocks is None:
            key = np.repeat(np.arange(len(self.terms)), self.df) * count + self.doc // BLOCK
            starts = runs(np.diff(key) != 0)[:-1]
            first = np.searchsorted(key[starts], np.arange(len(self.terms) + 1) * count)
            most = np.maximum.reduceat(self.impact, starts).astype(float) / np.where(self.idf > 0, self.idf, 1)[key[starts] // count]
            self.blocks = key[starts] % count, most, first
        block, most, first = self.blocks
        where, which = ranges(first[term], first[term + 1])
        return np.flatnonzero(np.bincount(block[where], most[where] * idf[which], count) * NEAR >= floor - 1e-6)

    def exact(self, docs: np.ndarray, term: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Scores of documents; sums run in order of the terms' hashes."""
        self.weights[term] = idf
        where, which = ranges(self.doc_first[docs], self.doc_last[docs])
        tf = self.doc_tf[where]
        x = self.weights[self.doc_term[where]] * (tf * (K1 + 1) / (tf + self.length[docs][which]))
        self.weights[term] = 0
        return np.bincount(which, x, len(docs))

    def rare(self, query: np.ndarray, term: np.ndarray, floor: np.ndarray) -> dict[int, np.ndarray]:
        """Of queries that can't reach the floor by terms of long lists alone, if the other lists are short: the documents that may reach it.

        A document in none of the other lists stays under FAR of the floor; of those in some, the lists' sum and all that
        the long lists may add must reach it.
        """
        n, df, most = len(floor), self.df[term], self.most[term]
        long, rest, work = np.full(n, -1), np.zeros(n), np.zeros(n)
        for least in sorted({max(2, self.n // x) for x in (16, 64, 256, 1024)}):
            some = df >= least
            may = np.bincount(query, most * some, n)
            short = np.bincount(query, df * ~some, n)
            now = (long < 0) & (floor > 0) & (may * NEAR < FAR * floor) & (32 * short <= self.n)
            long[now], rest[now], work[now] = least, may[now], short[now]
        some = np.flatnonzero(df < long[query])
        where, which = ranges(self.first[term[some]], self.last[term[some]])
        key = query[some][which] * self.n + self.doc[where]
        order = np.argsort(key, kind="stable")
        key = key[order]
        out = {int(q): np.zeros(0, np.int64) for q in np.flatnonzero(long >= 0)}
        if len(key):
            starts = runs(np.diff(key) != 0)[:-1]
            q, doc = np.divmod(key[starts], self.n)
            reach = (np.add.reduceat(self.impact[where][order], starts, dtype=float) + rest[q]) * NEAR >= floor[q] - 1e-6
            q, doc = q[reach], doc[reach]
            ends = runs(np.diff(q) != 0) if len(q) else [0]
            out |= {int(q[a]): doc[a:b] for a, b in zip(ends, ends[1:], strict=False)}
        return out

    def search(self, pack: Pack, top: int) -> np.ndarray:
        """The best documents (FOUND) of each query of a batch that reach its floor."""
        at = np.minimum(np.searchsorted(self.terms, pack.terms), len(self.terms) - 1)
        at = np.where(self.terms[at] == pack.terms, at, -1)
        self.weigh(at[at >= 0], pack.idf[at >= 0])
        at = at[pack.term]
        query, there = np.repeat(np.arange(pack.n), np.diff(pack.starts)), at >= 0
        query, at, idf = query[there], at[there], pack.idf[pack.term[there]]
        bound = np.minimum(np.bincount(query, self.most[at], pack.n), self.own.max()) * NEAR
        alive = (bound > 0) & (bound >= pack.floor - 1e-6)
        if not alive.any():
            return np.zeros(0, FOUND)
        some = alive[query]
        query, at, idf = query[some], at[some], idf[some]
        ends = np.searchsorted(query, np.arange(pack.n + 1))
        rare = self.rare(query, at, pack.floor)
        out, rest = [], []
        for q in np.flatnonzero(alive).tolist():
            some = slice(ends[q], ends[q + 1])
            if (docs := rare.get(q)) is None and 0 < pack.floor[q] and bound[q] < PIVOTAL * pack.floor[q]:
                blocks = self.pivots(at[some], idf[some], pack.floor[q])
                if 16 * len(blocks) * BLOCK <= self.n:
                    docs = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                    docs = docs[docs < self.n]
            if docs is None:
                rest.append(q)
            elif len(docs):
                out.append(self.best(q, docs, at[some], idf[some], pack.floor[q], top))
        if rest:
            line = np.full(pack.n, -1)
            line[rest] = np.arange(len(rest))
            row = self.row[at]
            some = np.flatnonzero((row >= 0) & (line[query] >= 0))
            weight = np.zeros((len(rest), len(self.dense)), np.float32)
            weight[line[query[some]], row[some]] = 1
            dense = weight @ self.dense
            # Short lists of all queries are gathered at once, long ones taken as they lie.
            few = np.flatnonzero((row < 0) & (line[query] >= 0) & (self.df[at] < SHORT))
            where, which = ranges(self.first[at[few]], self.last[at[few]])
            short, cut = self.lists[where], np.searchsorted(query[few][which], np.arange(pack.n + 1))
            long = np.flatnonzero((row < 0) & (line[query] >= 0) & (self.df[at] >= SHORT))
            first, last, upto = self.first[at[long]].tolist(), self.last[at[long]].tolist(), np.searchsorted(query[long], np.arange(pack.n + 1))
            for r, q in enumerate(rest):
                lists = [self.lists[a:b] for a, b in zip(first[upto[q] : upto[q + 1]], last[upto[q] : upto[q + 1]], strict=True)]
                docs = self.candidates(dense[r], [*lists, short[cut[q] : cut[q + 1]]], pack.floor[q], top)
                if len(docs):
                    some = slice(ends[q], ends[q + 1])
                    out.append(self.best(q, docs, at[some], idf[some], pack.floor[q], top))
        return np.concatenate(out) if out else np.zeros(0, FOUND)

    def candidates(self, dense: np.ndarray, lists: list[np.ndarray], floor: float, top: int) -> np.ndarray:
        """Documents that may be among the best, from the scores of common terms and the postings of the others."""
        n = sum(map(len, lists))
        if n > len(self.room):
            self.room = np.empty(2 * n, np.int64)
        found = np.concatenate(lists, out=self.room[:n]).view(POSTING)
        scores = np.bincount(found["doc"], found["impact"], self.n) + dense
        docs = np.flatnonzero(scores >= max(floor * (1 - SLACK) - 1e-6, 1e-12))
        if len(docs) > top:
            least = np.partition(scores[docs], len(docs) - top)[len(docs) - top]
            docs = docs[scores[docs] >= least * (1 - 2 * SLACK) - 1e-6]
        return docs

    def best(self, q: int, docs: np.ndarray, term: np.ndarray, idf: np.ndarray, floor: float, top: int) -> np.ndarray:
        score = np.round(self.exact(docs, term, idf), 6)
        some = np.flatnonzero((score > 0) & (score >= floor - 1e-6))
        some = some[np.lexsort((self.ids[self.ids_first[docs[some]]], -score[some]))][:top]
        where, which = ranges(self.ids_first[docs[some]], self.ids_last[docs[some]])
        doc, score = self.ids[where], score[some][which]
        first = np.lexsort((doc, -score))[:top]
        out = np.empty(len(first), FOUND)
        out["q"], out["doc"], out["score"] = q, doc[first], score[first]
        return out


def turned(batch: int) -> int:
    """Where a batch begins in the circle of shards."""
    return (batch * 0x9E3779B97F4A7C15 % (1 << 64)) >> 24


def searched(shards: DataFrame, packs: str, mean: float, n: int, first: int, last: int, top: int, like: dict[int, tuple[int, int]]) -> DataFrame:
    """batch and found: the best documents in shards first to last in each batch's own order. packs: path of the batches; like: of each label its first shard and their number."""
    parallel = shards.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-3 * parallel // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index = None

                def mine(b: int, number=number, chunk=chunk) -> bool:
                    turn = turned(b)
                    at, some = like.get(b >> 32, (0, n))
                    return turn % chunks == chunk and first <= (number - at - turn // chunks % some) % n < last

                for pack in packs_of(packs, mine):
                    index = index or Index(mean, **load(path))
                    found = index.search(pack, top)
                    if len(found):
                        yield pa.RecordBatch.from_pylist([{"batch": pack.batch, "found": found.tobytes()}], pa.schema([("batch", pa.int64()), ("found", pa.binary())]))
                del index
        trim()

    units = shards.select("path", "number", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).repartition(n * chunks)
    return units.mapInArrow(run, "batch bigint, found binary")


def merged(found: DataFrame, top: int) -> DataFrame:
    """batch, found (the best of all rows of a batch, in order of queries and ranks) and floor (of each query its k-th score)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["found"]), FOUND)
        x = x[np.lexsort((x["doc"], -x["score"], x["q"]))]
        ends = runs(np.diff(x["q"]) != 0)
        rank = np.arange(len(x)) - np.repeat(ends[:-1], np.diff(ends))
        floor = np.zeros(int(x["q"].max()) + 1)
        last = rank == top - 1
        floor[x["q"][last]] = x["score"][last]
        return pd.DataFrame({"batch": [key[0]], "found": [x[rank < top].tobytes()], "floor": [floor.tobytes()]})

    return found.groupBy("batch").applyInPandas(run, "batch bigint, found binary, floor binary")


RESULT = "query bigint, rank int, doc_id bigint, score double"


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query, rank, doc_id and score of the top documents of docs (doc_id, text) for each row of queries (doc_id, text)."""
    spark = docs.sparkSession
    some = lambda df: df.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    docs, asked = some(docs), some(queries).distinct()
    rows = docs.count()
    layout = laid_out(docs, rows, max(min(spark.sparkContext.defaultParallelism, rows // LEAST_DOCS), -(-rows // SHARD_DOCS)))
    shards = materialise(indexed(tokenised(docs, layout, True, top), layout, top), "shards")
    count, n, words = shards.agg(F.count("*"), F.sum("docs"), F.sum("words")).first()
    if not count:
        return spark.createDataFrame([], RESULT)
    shards = materialise(shards.withColumn("number", F.row_number().over(Window.orderBy("path")) - 1), "numbered")  # a row a shard
    like = {r.label: (r.at, r.n) for r in shards.groupBy("label").agg(F.min("number").alias("at"), F.count("*").alias("n")).collect()}
    packs = materialise(packed(tokenised(asked, layout, False, None)), "queries")
    batches = weighted(packs, frequencies(shards.repartition(count)), n)
    best, first, last = None, 0, 1
    while first < count:
        path = scratch_path(spark, "batches")
        (batches if best is None else batches.drop("floor").hint("merge").join(best.select("batch", "floor"), "batch", "left")).write.option("parquet.block.size", 8 << 20).parquet(path)
        batches = spark.read.parquet(path)
        found = searched(shards, path, words / n, count, first, min(last, count), top, like)
        best = materialise(merged(found if best is None else found.unionByName(best.select("batch", "found")), top), "best")
        first, last = last, last * GROWTH

    def ranked(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in rows:
            for query, asks, found in zip(part["query"], part["asks"], part["found"], strict=True):
                x, ids, asks = np.frombuffer(found, FOUND), np.frombuffer(query, "<i8"), np.frombuffer(asks, "<i8")
                ends, upto = runs(np.diff(x["q"]) != 0), np.cumsum(asks)
                rank = np.arange(len(x)) - np.repeat(ends[:-1], np.diff(ends)) + 1
                for q in np.split(np.arange(len(x)), ends[1:-1]):
                    k = x["q"][q[0]]
                    for a in range(upto[k] - asks[k], upto[k], 1 << 16):
                        own = ids[a : min(a + (1 << 16), upto[k])]
                        yield pd.DataFrame({"query": np.repeat(own, len(q)), "rank": np.tile(rank[q], len(own)), "doc_id": np.tile(x["doc"][q], len(own)), "score": np.tile(x["score"][q], len(own))})

    return packs.select("batch", "query", "asks").hint("merge").join(best.select("batch", "found"), "batch").select("query", "asks", "found").mapInPandas(ranked, RESULT)
