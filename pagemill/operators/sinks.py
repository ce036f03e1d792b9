"""Documents to files: JSON and Markdown, one file a document, and crops as PNG."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from pagemill.functions.images import encode_png

FORMATS = {"json": ("json",), "markdown": ("markdown",), "both": ("json", "markdown")}
SUFFIX = {"json": ".json", "markdown": ".md"}
WRITTEN = "doc_id bigint, path string, bytes bigint"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))


def put(folder: str, name: str, data: bytes) -> str:
    """Write under another name and rename, so readers never see half a file."""
    system, base = opened(folder)
    path = f"{base}/{name}"
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)
    return path


def write_documents(documents: DataFrame, folder: str, form: str = "both") -> DataFrame:
    """Write documents (doc_id, json and/or markdown) below folder, which all executors share; returns what was written, lazily."""
    if form not in FORMATS:
        raise ValueError("format must be json, markdown or both")
    names = FORMATS[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for n in names:
                    data = (row[n] or "").encode("utf-8", "surrogatepass")
                    rows.append({"doc_id": row["doc_id"], "path": put(folder, f"{row['doc_id']}/document{SUFFIX[n]}", data), "bytes": len(data)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("bytes", pa.int64())]))

    return documents.select("doc_id", *names).mapInArrow(run, WRITTEN)


def write_assets(assets: DataFrame, folder: str) -> DataFrame:
    """Write crops (doc_id, asset, crop as PNG) below their documents' folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": r["doc_id"], "path": put(folder, f"{r['doc_id']}/{r['asset']}", r["crop"]), "bytes": len(r["crop"])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("bytes", pa.int64())]))

    return assets.select("doc_id", "asset", "crop").mapInArrow(run, WRITTEN)


def write_crops(crops: DataFrame, folder: str) -> DataFrame:
    """Write crops (doc_id, page, position, width, height, rgb) as assets/page-N-box-I.png."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                image = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
                data = encode_png(image)
                rows.append({"doc_id": r["doc_id"], "path": put(folder, f"{r['doc_id']}/assets/page-{r['page']}-box-{r['position']}.png", data), "bytes": len(data)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("bytes", pa.int64())]))

    return crops.select("doc_id", "page", "position", "width", "height", "rgb").mapInArrow(run, WRITTEN)
