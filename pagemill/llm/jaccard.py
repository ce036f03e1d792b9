"""N-gram Jaccard join by chosen paths.

A document's set holds its shingles of five consecutive words (all words of a shorter text). Documents with equal sets form
one class and travel once. Candidates come from chosen-path runs over a min-hash embedding of TOKENS tokens: at each tree node
a token is sampled by a shared hash with probability 1 / (threshold * TOKENS), every set joins the child of each sampled token
that it holds, buckets of at most SMALL sets are brute-forced on the embedding, larger ones split again up to DEPTH levels.
Runs repeat until the chance that no run keeps a pair at the threshold together is under 1 - TARGET_RECALL. A bucket yields
one link to a root for each set that resembles others, never all pairs. Within each component of these links the exact
shingle sets are compared, in block pairs where a component or a last bucket is large, so hot groups spread over tasks.

Defined cases: null, empty and word-less texts have empty sets and link with nothing; rows without doc_id are left out of the
join (deduplication keeps them); repeated rows are copies; the keeper of a class is its smallest doc_id, of repeated ids the
one whose text has the smaller hash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise, trim
from pagemill.llm.components import components
from pagemill.llm.words import hashed, texts_of
from pagemill.llm.words import numbered as word_numbers

WORDS = 5
#: Similarity of at least 4 / 5.
NUMERATOR, DENOMINATOR = 4, 5
TOKENS = 64
SMALL, DEPTH = 128, 3
TARGET_RECALL = 0.999
#: Links of buckets need this share of equal tokens (3.6 standard deviations under the threshold); the exact check follows.
RESEMBLANCE = 0.62
#: Most sets in a block of a large group: bytes of embeddings or of whole texts for two blocks must fit a task.
BLOCK, TEXT_BLOCK = 1024, 256
REMEMBERED = 1 << 17
#: Rows (some 50 bytes each) up to which the documents of components are broadcast rather than shuffled.
BROADCAST_ROWS = 200_000

_A = np.random.default_rng(7).integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(1, 1 << 63, TOKENS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles; remembers words' hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mixed(out * _P + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def shingle_sets(data: bytes, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Texts that have words, and their sets of hashed shingles, as Shingler.hashes gives them."""
    row, code, words = word_numbers(data, offsets)
    h, counts = hashed(words)[code], np.bincount(row, minlength=len(offsets) - 1)
    long = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        long = mixed(long * _P + h[k : len(long) + k])
    some, first = np.flatnonzero(counts), np.cumsum(counts) - counts
    sets = []
    for r in some:
        a, m = first[r], counts[r]
        if m >= n:
            sets.append(np.unique(long[a : a + m - n + 1]))
        else:
            one = np.full(1, m, np.uint64)
            for k in range(m):
                one = mixed(one * _P + h[a + k])
            sets.append(one)
    return some, sets


def embedded(sets: list[np.ndarray]) -> np.ndarray:
    """A row of TOKENS minima for each set, none of which is empty."""
    if not sets:
        return np.zeros((0, TOKENS), np.uint32)
    x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat((x * a + b) >> np.uint64(32), starts) for a, b in zip(_A, _B, strict=True)], axis=1).astype(np.uint32)


def tkey(text="text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


SKETCH = "doc_id bigint, tkey bigint, digest binary, sketch binary"


def sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, _, data, offsets in texts_of(batch.column(2), 400):
                some, sets = shingle_sets(data, offsets)
                if sets:
                    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                    yield pa.RecordBatch.from_pydict({"doc_id": ids[at + some], "tkey": keys[at + some], "digest": digests, "sketch": [row.tobytes() for row in embedded(sets)]})
        trim()

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), tkey().alias("tkey"), "text").mapInArrow(run, SKETCH)


def runs_needed(depth: int = DEPTH, recall: float = TARGET_RECALL) -> int:
    """A pair at the threshold shares one sampled token a node on average; it lives to depth k with chance s(k) = 1 - exp(-s(k - 1))."""
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return math.ceil(math.log(1 - recall) / math.log(1 - s))


def children(paths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: of each path, the tokens of its row that are sampled there."""
    limit = np.uint64(int((1 << 64) * DENOMINATOR / (NUMERATOR * TOKENS)))
    drawn = mixed(tokens ^ paths[:, None])
    rows, cols = np.nonzero(drawn < limit)
    return rows, mixed(drawn[rows, cols] + _P).view(np.int64)


def tokens_of(sketch: pd.Series) -> np.ndarray:
    values = np.frombuffer(b"".join(sketch), np.uint32).reshape(-1, TOKENS).astype(np.uint64)
    return mixed(values | (np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)))


def split(rows: DataFrame, runs: int = 0) -> DataFrame:
    """Children of rows (key, digest, sketch); with runs, the first level of that many runs of rows (digest, sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                tokens = tokens_of(part["sketch"])
                digests = part["digest"].to_numpy()
                for r in range(max(1, runs)):
                    paths = mixed(np.full(len(part), r + 1, np.uint64) * _P) if runs else part["key"].to_numpy(np.int64).view(np.uint64)
                    chosen, keys = children(paths, tokens)
                    yield pd.DataFrame({"key": keys, "digest": digests[chosen]})

    return rows.mapInPandas(run, "key bigint, digest binary")


def dealt(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """rows with cells (lo, hi) and block b: a group of up to block rows is one cell; a larger one has a cell for each pair of blocks."""
    blocks = F.ceil(F.col(size) / block)
    own = F.pmod(F.xxhash64("digest"), blocks)
    return (
        rows.withColumn("b", own).withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .withColumn("lo", F.least("b", "o")).withColumn("hi", F.greatest("b", "o")).drop("o", size)
        .repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "digest")
    )


def whole_cells(batches: Iterator[pd.DataFrame], group: str) -> Iterator[pd.DataFrame]:
    """The same rows, cut so that no cell is split; each frame has a cell number in column cell."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        ids = list(zip(batch[group], batch["lo"], batch["hi"], strict=True))
        change = np.array([True] + [a != b for a, b in zip(ids[1:], ids, strict=False)])
        change[0] = ids[0] != last
        last = ids[-1]
        starts = np.flatnonzero(change)
        if len(starts):
            held.append(batch.iloc[: starts[-1]])
            if rows := sum(map(len, held)):
                yield numbered(pd.concat(held, ignore_index=True) if rows else held[0], group)
            held = [batch.iloc[starts[-1] :]]
        else:
            held.append(batch)
    if held and sum(map(len, held)):
        yield numbered(pd.concat(held, ignore_index=True), group)


def numbered(rows: pd.DataFrame, group: str) -> pd.DataFrame:
    return rows.assign(cell=rows.groupby([group, "lo", "hi"], sort=False).ngroup())


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is linked with, through any number of links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def resembling(leaves: DataFrame) -> DataFrame:
    """Links u-v from buckets (key, size, digest, sketch) to the least set of each that they hang together with."""
    least = math.ceil(RESEMBLANCE * TOKENS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_cells(batches, "key"):
            cell, b, cross = rows["cell"].to_numpy(), rows["b"].to_numpy(), (rows["lo"] != rows["hi"]).to_numpy()
            sketch = (np.frombuffer(b"".join(rows["sketch"]), np.uint32).reshape(-1, TOKENS) & np.uint32(255)).astype(np.uint8)
            left, right = [], []
            for d in range(1, len(rows)):
                i = np.flatnonzero(cell[d:] == cell[:-d])
                if not len(i):
                    break
                i = i[~cross[i] | (b[i] != b[i + d])]
                for k in range(0, len(i), 1 << 16):
                    some = i[k : k + (1 << 16)]
                    some = some[(sketch[some] == sketch[some + d]).sum(axis=1) >= least]
                    left.append(some)
                    right.append(some + d)
            if not left:
                continue
            label = rooted(len(rows), np.concatenate(left), np.concatenate(right))
            at = np.flatnonzero(label != np.arange(len(rows)))
            digest = rows["digest"].to_numpy()
            yield pd.DataFrame({"u": digest[at], "v": digest[label[at]]})

    return dealt(leaves, "key", "size", BLOCK).mapInPandas(run, "u binary, v binary").distinct()


def candidates(classes: DataFrame, runs: int | None = None, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """Links between classes (digest, sketch) that probably resemble each other, a spanning set of them."""
    sketched = classes.select("digest", "sketch")
    rows, links = split(sketched, runs or runs_needed(depth)), []
    for level in range(1, depth + 1):
        rows = materialise(rows, f"level{level}")
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        rows = materialise(rows.join(sizes, "key").join(sketched, "digest"), f"buckets{level}")
        more = level < depth and bool(rows.where(F.col("size") > small).take(1))
        links.append(resembling(rows.where(F.col("size") <= small) if more else rows))
        if not more:
            break
        rows = split(rows.where(F.col("size") > small))
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, ids, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = uses[ids] > 1
    owner, ids = owner[keep], ids[keep]
    _, ids = np.unique(ids, return_inverse=True)
    out, width = np.zeros((m, m), np.float32), max(1, min(8192, (1 << 24) // (4 * m)))
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    cuts = np.searchsorted(ids, np.arange(0, (int(ids[-1]) if len(ids) else -1) + 1 + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((m, width), np.float32)
        part[owner[lo:hi], ids[lo:hi] - k * width] = 1
        out += part @ part.T
    return out


VERIFIED = "node binary, root binary, links bigint"


def verified(members: DataFrame) -> DataFrame:
    """For each cell and class of members (component, size, digest, copies, text): documents it links with there, and the least class it hangs together with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for rows in whole_cells(batches, "component"):
            for _, cell in rows.groupby("cell"):
                cell = cell.drop_duplicates("digest")
                sets = [shingler.hashes(t) for t in cell["text"]]
                size, copies = np.array([len(s) for s in sets]), cell["copies"].to_numpy(np.int64)
                linked = 9 * shared_counts(sets) >= 4 * (size[:, None] + size)  # 5 shared >= 4 (a + b - shared)
                np.fill_diagonal(linked, False)
                if cell["lo"].iloc[0] != cell["hi"].iloc[0]:
                    b = cell["b"].to_numpy()
                    linked &= b[:, None] != b
                digest = cell["digest"].to_numpy()
                yield pd.DataFrame({"node": digest, "root": digest[rooted(len(cell), *np.nonzero(linked))], "links": linked @ copies})

    return dealt(members, "component", "size", TEXT_BLOCK).mapInPandas(run, VERIFIED)


def join(docs: DataFrame, runs: int | None = None, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """doc_id, tkey, class_id, n_links and keeper for each row of docs that has a doc_id.

    class_id: least doc_id of the documents that links of similarity at least 0.8 connect; n_links: other rows so similar.
    """
    assert (NUMERATOR, DENOMINATOR) == (4, 5)
    rows = materialise(sketches(docs), "sketches")
    classes = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "tkey")).alias("keeper"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "classes")
    placed = components(candidates(classes, runs, small, depth)).select(F.col("node").alias("digest"), F.col("root").alias("component"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    known = materialise(placed.join(sizes, "component").join(classes.select("digest", "keeper.doc_id", "keeper.tkey", "copies"), "digest"), "members")
    many = known.agg(F.count("*"), F.max("size")).first()
    side = F.broadcast(known) if many[0] <= BROADCAST_ROWS else known
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), tkey().alias("tkey"), "text")
    members = texts.join(side, ["doc_id", "tkey"]).select("component", "size", "digest", "copies", "text")
    found = materialise(verified(members), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if (many[1] or 0) > TEXT_BLOCK:
        whole = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
        links = links.drop("root").join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    links = classes.select("digest", "keeper", "copies").join(links.withColumnRenamed("node", "digest"), "digest", "left")
    links = materialise(links.select("digest", "keeper", F.coalesce("root", "digest").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "links")
    best = links.groupBy("root").agg(F.min("keeper").alias("best"))
    classed = links.join(best, "root").select("digest", "best", "n_links")
    linked = rows.select("doc_id", "tkey", "digest").join(classed, "digest").select("doc_id", "tkey", F.col("best.doc_id").alias("class_id"), "n_links", (F.struct("doc_id", "tkey") == F.col("best")).alias("keeper"))
    empty = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), tkey().alias("tkey"), "text").where(F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$"))
    return linked.unionByName(empty.select("doc_id", "tkey", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("keeper")))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each class of docs, with docs' own columns; rows without doc_id stay."""
    key, mark = "_tkey", "_doc"
    while key in docs.columns or mark in docs.columns:
        key, mark = key + "_", mark + "_"
    kept = join(docs, **options).where("keeper").select(F.col("doc_id").alias(mark), F.col("tkey").alias(key)).distinct()
    whole = docs.where("doc_id is not null").join(kept, (F.col("doc_id").cast("bigint") == F.col(mark)) & (tkey() == F.col(key)))
    return whole.dropDuplicates([mark, key]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
