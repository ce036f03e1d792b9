"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, each text scanned once.

Text is folded to lower-case ASCII words joined by single spaces, so a window is a substring that begins and ends with a
space. Matching runs on the UTF-8 bytes (as Latin-1 characters, so one byte is one symbol); matches are mapped back to word
numbers, and for hit documents to code-point offsets of the original text.

A benchmark of over BLOCK_BYTES of windows becomes several automata, which a task loads one after the other for each CHUNK of
texts, so one is in memory at a time and each text travels to Python once.

Defined cases: a null or word-less text has no words and no hits; a null or word-less benchmark item has no window; windows of
an item without an id hit like others, and it is not among the items; items that share an id count once; repeated documents each get their own row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import scratch_path
from pagemill.llm.files import reading, writing

WINDOW = 13
#: Bytes of window text in one automaton (about 60 bytes of memory each). A larger benchmark is scanned in several blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of text that each of several automata scans before the next one is loaded.
CHUNK_BYTES = 32 << 20

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = "n_words bigint, n_hit bigint, items array<bigint>, runs array<bigint>, spans array<struct<start:bigint,end:bigint>>"


def folded(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows(text: str | None, width: int = WINDOW) -> list[bytes]:
    """The windows of one item: width consecutive words each, or all words of a shorter item."""
    words = folded(text)
    n = min(width, len(words))
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def automata(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[ahocorasick.Automaton]:
    """Automata over blocks of the benchmark, streamed through the driver one block at a time."""
    patterns: dict[bytes, list[int]] = {}
    size = 0

    def built() -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for window, ids in patterns.items():
            a.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(ids)))
        a.make_automaton()
        return a

    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        for window in windows(row["text"], width):
            size += 0 if window in patterns else len(window)
            ids = patterns.setdefault(window, [])
            if row["item_id"] is not None and row["item_id"] not in ids:
                ids.append(row["item_id"])
        if size > block_bytes:
            yield built()
            patterns, size = {}, 0
    if patterns:
        yield built()


def scan(text: str | None, automaton: ahocorasick.Automaton | None, runs: list[int], items: set[int]) -> tuple[int, list[int]]:
    """Number of words, and merged runs [first, last + 1, ...] of hit words; adds to items."""
    words = folded(text)
    if not words or automaton is None:
        return len(words), runs
    line = f" {b' '.join(words).decode('latin-1')} "
    found, seen, at = list(zip(runs[::2], runs[1::2], strict=True)), 0, 0
    for end, (n, ids) in automaton.iter(line):
        seen, at = seen + line.count(" ", at, end), end
        found.append((seen - n, seen))
        items.update(ids)
    merged: list[int] = []
    for first, last in sorted(found):
        if merged and first <= merged[-1]:
            merged[-1] = max(merged[-1], last)
        else:
            merged += [first, last]
    return len(words), merged


def spans_of(text: str, runs: list[int]) -> list[dict]:
    """Code-point offsets in the original text of runs of words."""
    out, want = [], iter(runs)
    if not runs:
        return out
    first, last = next(want), next(want)
    for i, m in enumerate(_WORD.finditer(text)):
        if i == first:
            begin = m.start()
        if i == last - 1:
            out.append({"start": begin, "end": m.end()})
            first, last = next(want, -1), next(want, -1)
            if first < 0:
                break
    return out


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Column:
    """A struct column (RESULT) for docs: words, hit words, items, runs of hit words, and their spans in the original."""
    spark = docs.sparkSession
    machines = automata(benchmark, width, block_bytes)
    first, second = next(machines, None), next(machines, None)
    shared, paths = spark.sparkContext.broadcast(first if second is None else None), []
    while second is not None:
        for machine in (first, second) if not paths else (second,):
            paths.append(f"{scratch_path(spark, 'automaton')}.pickle")
            with writing(paths[-1]) as out:
                pickle.dump(machine, out)
        first, second = None, next(machines, None)

    def loaded() -> Iterator[ahocorasick.Automaton | None]:
        if not paths:
            yield shared.value
        for path in paths:
            with reading(path) as (f, _):
                machine = pickle.load(f)
            yield machine
            del machine

    def scanned(held: list[pd.Series]) -> Iterator[pd.DataFrame]:
        found = [[(0, [], set()) for _ in texts] for texts in held]
        for machine in loaded():
            for texts, rows in zip(held, found, strict=True):
                for k, t in enumerate(texts):
                    _, runs, items = rows[k]
                    rows[k] = (*scan(t, machine, runs, items), items)
        for texts, rows in zip(held, found, strict=True):
            out = [(n, sum(runs[1::2]) - sum(runs[::2]), sorted(items), runs, spans_of(t, runs) if runs else []) for t, (n, runs, items) in zip(texts, rows, strict=True)]
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "items", "runs", "spans"])

    @F.pandas_udf(RESULT)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for texts in parts:
            held.append(texts)
            size += sum(len(t) for t in texts if t is not None)
            if not paths or size >= CHUNK_BYTES:
                yield from scanned(held)
                held, size = [], 0
        if held:
            yield from scanned(held)

    return run.asNondeterministic()(F.col(text))


def judged(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs' doc_id and, for each row, n_words, n_hit, items, runs, spans and contaminated."""
    found = docs.select("doc_id", hits(docs, benchmark, **options).alias("hit")).select("doc_id", "hit.*")
    return found.withColumn("contaminated", judged(F.col("n_hit"), F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' own columns."""
    mark = "_hit"
    while mark in docs.columns:
        mark += "_"
    return docs.withColumn(mark, hits(docs, benchmark, **options)).where(~judged(F.col(mark)["n_hit"], F.col(mark)["n_words"])).drop(mark)
