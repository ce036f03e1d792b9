"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

For each language a unigram distribution over the pieces of a public vocabulary is fitted by expectation maximisation; the
probability of a word is the sum over all its segmentations into pieces, found by the forward algorithm, and a text's is the
product over its words. The score is the posterior of the best language under a uniform prior. Characters outside the
vocabulary cost the same in every language.

Fitting uses labelled rows only: at most about SAMPLE_DOCS different texts a language (those of smallest hash; copies count
once, and all texts of a language that has fewer). For fitting, words are cut into pieces of TRAIN_CHARS characters. Scoring
covers every whole word of every text; a worker remembers the scores of words for all its tasks.

Defined cases: a null text, or one without a letter (Unicode category L: not a digit, fraction, Roman numeral sign or
mark), is `und` with score 0; so is every text when nothing is labelled; of
languages that tie, the first by code point wins; rows without lang don't train; repeated rows are predicted alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import per_process, trim

UNKNOWN = "und"
SAMPLE_DOCS = 1000
TRAIN_CHARS = 64
ROUNDS = 3
#: Pseudo-count of every piece, and probability of a character that no piece covers.
SMOOTHING, STRANGE = 0.05, 1e-7
CELLS = 1 << 18
REMEMBERED = 1 << 17
#: A model is languages x pieces; more languages than this are refused.
MOST_LANGUAGES = 500

_LETTER = regex.compile(r"\p{L}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces, in order of their ids."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Lattice:
    """Finds the pieces in many words at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: list[str]):
        self.size, self.by_length = len(vocabulary), {}
        lengths = np.array([len(p) for p in vocabulary])
        for n in sorted(set(lengths.tolist())):
            ids = np.flatnonzero(lengths == n)
            keys = self.rolled(self.coded([vocabulary[i] for i in ids], n), n)[:, 0]
            order = np.argsort(keys)
            self.by_length[n] = keys[order], ids[order]

    @staticmethod
    def coded(words: list[str], width: int) -> np.ndarray:
        """A row of code points for each word, 0 behind its end."""
        return np.array(words, f"<U{width}").view("<u4").reshape(len(words), width).astype(np.uint64)

    def rolled(self, codes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] - n + 1), np.uint64)
        for k in range(n):
            out = out * self.BASE + codes[:, k : codes.shape[1] - n + 1 + k]
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """Lengths of words, and by end position and piece length the rows and pieces; `size` stands for a strange character."""
        ends = np.array([len(w) for w in words])
        width = int(ends.max())
        codes = self.coded(words, width)
        out, single = [], np.full(codes.shape, self.size)
        for n, (keys, ids) in self.by_length.items():
            if n > width:
                break
            hashes = self.rolled(codes, n)
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            found = np.where(keys[at] == hashes, ids[at], -1)
            found[codes[:, n - 1 :] == 0] = -1
            if n == 1:
                single = np.where(found >= 0, found, single)
            else:
                cols, rows = np.nonzero(found.T >= 0)
                cuts = np.flatnonzero(np.diff(cols)) + 1
                for r, c in zip(np.split(rows, cuts), np.split(cols, cuts), strict=True):
                    if len(r):
                        out.append((int(c[0]) + n, n, r, found[r, c[0]]))
        out += [(i + 1, 1, r, single[r, i]) for i in range(width) if len(r := np.flatnonzero(ends > i))]
        out.sort(key=lambda e: (e[0], e[1]))
        return ends, out

    def batches(self, words: list[str]) -> Iterator[np.ndarray]:
        """Indices of words of like length, few enough to be handled together."""
        order = np.argsort([len(w) for w in words], kind="stable")
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and (n + 1) * len(words[order[min(len(order) - 1, at + 2 * n - 1)]]) <= CELLS and n < 8192:
                n = min(2 * n, len(order) - at)
            yield order[at : at + n]
            at += n

    def forward(self, words: list[str], probs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """alpha by position, row and language; log of the factor taken out of it by row and language; lengths; edges."""
        ends, edges = self.edges(words)
        width, k = int(ends.max()), probs.shape[1]
        alpha = np.zeros((width + 1, len(words), k))
        alpha[0] = 1
        taken, last, reach = np.zeros((len(words), k)), 0, max(self.by_length)
        for end, n, rows, ids in edges:
            if end > last:
                if last and last % 16 == 0:
                    live = ends > last
                    top = np.where(live[:, None], alpha[last], 1)
                    alpha[max(0, last - reach) : last + 1, live] /= top[live]
                    taken += np.log(top)
                last = end
            alpha[end, rows] += alpha[end - n, rows] * probs[ids]
        at = np.arange(len(words))
        with np.errstate(divide="ignore"):
            logs = np.log(alpha[ends, at]) + taken
        return alpha, logs, ends, edges

    def scores(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log of each word's probability in each language, over all segmentations."""
        out = np.zeros((len(words), probs.shape[1]))
        for some in self.batches(words):
            out[some] = self.forward([words[i] for i in some], probs)[1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, for words of at most TRAIN_CHARS characters; probs: one language."""
        out = np.zeros(self.size + 1)
        scale = 64.0  # a character costs some 4 nats: keeps products of 64 of them in range
        for some in self.batches(words):
            ends, edges = self.edges([words[i] for i in some])
            width, at = int(ends.max()), np.arange(len(some))
            alpha, beta = np.zeros((width + 1, len(some))), np.zeros((width + 1, len(some)))
            alpha[0], beta[ends, at] = 1, 1
            for end, n, rows, ids in edges:
                alpha[end, rows] += alpha[end - n, rows] * probs[ids] * scale**n
            total = counts[some] / alpha[ends, at]
            for end, n, rows, ids in reversed(edges):
                use = probs[ids] * scale**n * beta[end, rows]
                beta[end - n, rows] += use
                out += np.bincount(ids, alpha[end - n, rows] * use * total[rows], minlength=self.size + 1)
        return out


def marked(word: str) -> str:
    return "▁" + word


def fitted(words: list[str], counts: np.ndarray, lattice: Lattice, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language; the last is a strange character's."""
    p = np.full(lattice.size + 1, 1 / lattice.size)
    p[-1] = STRANGE
    for _ in range(rounds):
        c = lattice.expected(words, counts, p)[:-1] + SMOOTHING
        p[:-1] = c / c.sum()
    return p


def fit(labelled: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order of code points, and their piece probabilities, from labelled rows."""
    path = vocabulary or default_vocabulary()
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.countDistinct("h").alias("count")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return [], np.zeros((0, 0))
    steps = 1 << 30
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int(min(1, sample_docs / r["count"]) * steps))))
    sample = rows.where(F.pmod("h", F.lit(steps)) < share[F.col("lang")]).dropDuplicates(["lang", "h"])
    words = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\S{{1,{TRAIN_CHARS - 1}}}"), F.lit(0))).alias("word"))
        .groupBy("lang", "word").count()
    )

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lattice = Lattice(pieces(path))
        rows = rows.sort_values("word")
        p = fitted([marked(w) for w in rows["word"]], rows["count"].to_numpy(float), lattice)
        return pd.DataFrame({"lang": key[0], "probs": [p.astype("<f8").tobytes()]})

    found = sorted(words.groupBy("lang").applyInPandas(one, "lang string, probs binary").collect())
    return [r["lang"] for r in found], np.array([np.frombuffer(r["probs"], "<f8") for r in found]).T if found else np.zeros((0, 0))


class Scorer:
    def __init__(self, langs: list[str], probs: np.ndarray, vocabulary: list[str]):
        self.langs, self.probs, self.lattice = langs, probs, Lattice(vocabulary)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        split = [t.lower().split() if t is not None and self.langs and _LETTER.search(t) else None for t in texts]
        new = list(set().union(*(w for w in split if w)).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.lattice.scores([marked(w) for w in new], self.probs)])
        out = []
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            logs = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(np.argmax(logs))
            out.append((self.langs[best], float(1 / np.exp(logs - logs[best]).sum())))
        return out


def predictor(docs: DataFrame, langs: list[str], probs: np.ndarray, vocabulary: str | None = None, keep: bool = True) -> Column:
    """A function of a text column: struct of lang_pred and score. keep: workers remember words between tasks (some 30 MB each)."""
    path = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast((langs, probs))  # MOST_LANGUAGES times the vocabulary at most
    key = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept = per_process(("langid",), dict) if keep else {}  # one model a worker
        if kept.get("key") != key:
            kept.clear()
            kept.update(key=key, scorer=Scorer(*shared.value, pieces(path)))
        scorer = kept["scorer"]
        for texts in parts:
            rows = [r for at in range(0, len(texts), 500) for r in scorer.predict(texts.iloc[at : at + 500].tolist())]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])
        del kept, scorer
        trim()

    return run.asNondeterministic()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs; learns from those that aren't held out."""
    langs, probs = fit(docs.where(~held_out(F.col("doc_id"))), vocabulary, sample_docs)
    run = predictor(docs, langs, probs, vocabulary)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), run("text").alias("p")).select("doc_id", "held_out", "p.*")


def identified(docs: DataFrame, least_score: float = 0.5, **options) -> DataFrame:
    """The rows of docs whose language can be told with at least least_score, with docs' own columns."""
    mark = "_lang"
    while mark in docs.columns:
        mark += "_"
    langs, probs = fit(docs.where(~held_out(F.col("doc_id"))), **options)
    run = predictor(docs, langs, probs, keep=False)  # the next steps of a pipeline need the memory
    return docs.withColumn(mark, run("text")).where((F.col(mark)["lang_pred"] != UNKNOWN) & (F.col(mark)["score"] >= least_score)).drop(mark)
