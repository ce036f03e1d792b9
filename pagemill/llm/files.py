"""Files in the cluster's shared folder, written and read by executors through pyarrow's file systems."""

from __future__ import annotations

import contextlib
import io
import os
import re
from collections.abc import Iterator

import numpy as np
import zstandard as zstd
from pyarrow import fs
from pyspark import TaskContext


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^s3[an]://", "s3://", path)  # Hadoop's names of the same store
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def task_file(folder: str, k: int, suffix: str) -> str:
    """A name that no other task or attempt uses; readers go by the manifest of tasks that ended well."""
    c = TaskContext.get()
    return f"{folder}/part-{c.partitionId():06d}-{k:04d}-{c.taskAttemptId()}{suffix}"


@contextlib.contextmanager
def writing(path: str) -> Iterator:
    system, name = open_fs(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    with system.open_output_stream(name, compression=None) as out:
        yield out


@contextlib.contextmanager
def reading(path: str) -> Iterator:
    """A seekable file and its size."""
    system, name = open_fs(path)
    with system.open_input_file(name) as f:
        yield f, f.size()


def save(path: str, **arrays: np.ndarray) -> None:
    """Arrays as one compressed file with a checksum."""
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    with writing(path) as out:
        out.write(zstd.ZstdCompressor(level=1, write_checksum=True).compress(raw.getbuffer()))


def load(path: str) -> dict[str, np.ndarray]:
    with reading(path) as (f, size):
        return dict(np.load(io.BytesIO(zstd.ZstdDecompressor().decompress(f.read(size)))))
