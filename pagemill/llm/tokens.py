"""Token-ID output: documents in ascending doc_id order to rANS-coded files, and back.

Texts are dealt by ranges of doc_id and sorted, so the files in order of their ranges hold all documents in ascending order.
Each task tokenises its rows, fills a file of at most FILE_IDS ids (more only if one document alone has more), counts the
file's ids in full for the table its blocks share, and writes it. The manifest has one row for each file.

The tokenizer drops white space and never joins across it, so a text's ids are those of its space-separated words in turn;
each Python worker encodes a distinct word once. A run of Latin letters is encoded in lower case, as the tokenizer does, and
splits from punctuation behind it, also as the tokenizer does; texts for which that isn't sure are split at spaces only.

Defined cases: a null or empty text has only the end id; documents that share an id are in order of their texts; null
doc_ids come first; an empty table makes no file and no row.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, compress
from operator import attrgetter, not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import files, rans
from pagemill.llm.common import materialise, per_process, scratch_path

END = 2
_END = struct.pack("<I", END)
FILE_IDS = 1 << 23
#: Words one worker remembers (some 200 bytes each) before it starts anew.
REMEMBERED = 1 << 20

#: str.split() splits at these, the tokenizer doesn't.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: UTF-8 bytes as a letter or digit, stop or comma, space, other punctuation, or (letters beyond Latin-1 and all else) unsure.
_KINDS = bytes(
    97 if 0x80 <= c < 0xC0 or c == 0xC3 or chr(c).isalnum() and c < 0x80 else 46 if c in b".," else 32 if c in b" \t\n\v\f\r" else 33 if 33 <= c < 127 else 63
    for c in range(256)
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spaced(text: str | None) -> list[str]:
    """Parts of text that the tokenizer encodes one by one, in order: words, with a stop or comma behind one apart if that is sure."""
    if not text:
        return []
    low = text.lower()
    kinds = low.encode("utf-8", "surrogatepass").translate(_KINDS)
    if b"?" not in kinds and b"!. " not in kinds and b".. " not in kinds and "×" not in low and "÷" not in low:
        return low.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").split()
    return text.split() if not any(c in text for c in _SEPARATORS) else re.findall(r"[^ \t-\r]+", text)


def byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.letters = Tokenizer.from_file(path), {}, byte_letters()
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(64)]
        # One run of Latin letters may skip the steps before the model, if they only fold it to lower case and byte letters.
        probe = ["Straße", "ÉCOLE", "naïveté", "q", "Abcdefghijklmnopqrstuvwxyz", "çà", "aaaaaaaaaaaa", "s", "LL"]
        self.direct = all(self.run(w.lower()) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def run(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]

    def packed(self, ids: list[int]) -> bytes:
        return self.packs[len(ids)](*ids) if len(ids) < len(self.packs) else struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: set[str]) -> None:
        known, tokenize, letters, latin, packed = self.known, self.tokenizer.model.tokenize, self.letters, _LATIN.fullmatch, self.packed
        ident = attrgetter("id")
        rest, parted = [], []
        for w in words:
            if not self.direct:
                rest.append(w)
            elif w.isascii() and w.isalpha() and w.islower():
                known[w] = packed(list(map(ident, tokenize(w))))
            elif m := latin(w):
                parted.append((w, m[1].lower(), m[2]))
            else:
                rest.append(w)
        rest += {stop for _, _, stop in parted if stop}.difference(known)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = packed(e.ids)
        for w, core, stop in parted:
            if (ids := known.get(core)) is None:
                ids = known[core] = packed(list(map(ident, tokenize(core if core.isascii() else core.encode().decode("latin-1").translate(letters)))))
            known[w] = ids + known[stop] if stop else ids

    def encode(self, texts: list[str | None], remembered: int = REMEMBERED) -> list[bytes]:
        """The ids of each text, with the end id, as little-endian unsigned 32-bit integers."""
        if len(self.known) > remembered:
            self.known.clear()
        known, split = self.known, [spaced(t) for t in texts]
        found, new = [list(map(known.get, w)) for w in split], set()
        for w, ids in zip(split, found, strict=True):
            new.update(compress(w, map(not_, ids)))
        self.learn(new)
        for w, ids in zip(split, found, strict=True):
            missing = list(compress(range(len(w)), map(not_, ids)))
            for i, coded in zip(missing, map(known.__getitem__, map(w.__getitem__, missing)), strict=True):
                ids[i] = coded
            ids.append(_END)
        return [b"".join(ids) for ids in found]


MANIFEST = "part int, file int, path string, ids bigint, documents bigint"


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, file_ids: int = FILE_IDS, remembered: int = REMEMBERED) -> DataFrame:
    """Write docs' ids to files in folder; returns the manifest, already run and kept in the shared folder."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, k = per_process(("tokens", tokenizer), lambda: Encoder(tokenizer)), TaskContext.get().partitionId(), 0
        ids, doc_ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            path = files.task_file(folder, k, ".pmtok")
            with files.writing(path) as out:
                rans.pack_file(np.frombuffer(b"".join(ids), "<u4"), doc_ids, [len(x) // 4 for x in ids], out.write)
            return pa.RecordBatch.from_pylist([{"part": part, "file": k, "path": path, "ids": size, "documents": len(ids)}], schema)

        schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("ids", pa.int64()), ("documents", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for doc, coded in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist(), remembered), strict=True):
                    if ids and size + len(coded) // 4 > file_ids:
                        yield flush()
                        ids, doc_ids, size, k = [], [], 0, k + 1
                    ids.append(coded)
                    doc_ids.append(doc)
                    size += len(coded) // 4
        if ids:
            yield flush()

    placed = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(placed.mapInArrow(run, MANIFEST), "token-manifest")


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read(manifest: DataFrame) -> DataFrame:
    """What the files hold, read back: doc_id, start, n_tokens, ids_crc32. Each file is decoded by one task."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file, some 10 MB each
    placed = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, start in chain.from_iterable(zip(b["path"], b["start"], strict=True) for b in batches):
            rows = []
            with files.reading(path) as (f, size):

                def read_at(at: int, n: int, f=f) -> bytes:
                    f.seek(at)
                    return f.read(n)

                for doc, ids in rans.Reader(read_at, size).documents():
                    rows.append((doc, int(start), len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                    start += len(ids)
            out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
            out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
            yield out

    return placed.repartition(max(1, manifest.count()), "path").mapInPandas(run, READ)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    return read(write(docs, scratch_path(docs.sparkSession, "tokens"), **options))
