"""WARC archives of Zstandard frames: a dictionary in a leading skippable frame, then one frame for each record.

Writing: payload digests are counted; of equal payloads of at least LEAST_REVISIT bytes the one with the smallest page_id is a
response, the others are revisits that refer to it; all others are responses. Each task writes files of its own, at most about
FILE_BYTES of record bytes each, with a dictionary trained on the file's first SAMPLE_BYTES. The manifest lists the files.

Reading: each file is streamed by one task, one record in memory; frames, headers, lengths and digests are checked, and a
fault raises ValueError.

Defined cases: null html is an empty payload; a null url has no target header; a null page_id has no id, counts as larger than
all others and refers_to stays null where no equal payload has an id; rows that repeat the smallest page_id are all responses;
an empty table makes no file and no row.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import files
from pagemill.llm.common import materialise, scratch_path

LEAST_REVISIT = 100
FILE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 256 << 20, 2 << 20, 64 << 10
LEVEL = 3
MOST_RECORD = 1 << 30
#: Rows (digest and id, some 80 bytes) up to which repeated payloads are broadcast.
BROADCAST_ROWS = 200_000

DICTIONARY_FRAME, FRAME = 0x184D2A5D, 0xFD2FB528
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{sha256(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstd.ZstdCompressionDict | None:
    """A dictionary from the first records of a file; from their bytes as they are where there are too few to train on."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples)
    except zstd.ZstdError:
        raw = b"".join(samples)[:DICTIONARY_BYTES]
        return zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


class Writer:
    def __init__(self, out, samples: list[bytes]):
        self.out, d = out, trained(samples)
        if d is not None:
            stored = zstd.ZstdCompressor(level=LEVEL).compress(d.as_bytes())
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(stored)) + stored)
            d.precompute_compress(level=LEVEL)
        self.packer = zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True, write_content_size=True)
        for s in samples:
            self.add(s)

    def add(self, data: bytes) -> None:
        self.out.write(self.packer.compress(data))


MANIFEST = "path string, records bigint"


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to archives in folder; returns the manifest, already run."""
    rows = pages.select(F.col("page_id").cast("bigint"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    repeated = materialise(repeated.drop("n"), "payloads")
    rows = rows.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated, "digest", "left")
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = (
            record(None if pd.isna(r.page_id) else int(r.page_id), r.url, bytes(r.payload), r.digest, int(r.first) if r.revisit else None, bool(r.revisit))
            for batch in batches for r in batch.itertuples(index=False)
        )
        for k, first in enumerate(records):
            path, n, size, samples, seen = files.task_file(folder, k, ".warc.zst"), 0, 0, [], 0
            with files.writing(path) as out:
                writer = None
                for data in chain([first], records):
                    n, size = n + 1, size + len(data)
                    if writer is not None:
                        writer.add(data)
                    else:
                        samples.append(data)
                        seen += len(data)
                        if seen >= SAMPLE_BYTES:
                            writer = Writer(out, samples)
                    if size >= file_bytes:
                        break
                if writer is None:
                    Writer(out, samples)
            yield pd.DataFrame({"path": [path], "records": [n]})

    return materialise(rows.select("page_id", "url", "payload", "digest", "first", "revisit").mapInPandas(run, MANIFEST), "warc-manifest")


def frames(f) -> Iterator[bytes]:
    """The decoded frames of an open archive, after its dictionary frame."""

    def exactly(n: int) -> bytes:
        data = f.read(n)
        if len(data) != n:
            raise ValueError("the archive is cut short")
        return data

    data, held = exactly(8), None
    magic, size = struct.unpack("<II", data)
    if magic == DICTIONARY_FRAME:
        stored, data = exactly(size), b""
        if stored[:4] == struct.pack("<I", FRAME):
            stored = zstd.ZstdDecompressor().decompress(stored, max_output_size=16 << 20)
        held = zstd.ZstdCompressionDict(stored)
    reader = zstd.ZstdDecompressor(dict_data=held, max_window_size=1 << 27)
    while data := data or f.read(1 << 16):
        while len(data) < 18 and (more := f.read(1 << 16)):
            data += more
        try:
            said = zstd.get_frame_parameters(data).content_size
        except zstd.ZstdError as e:
            raise ValueError(f"not a frame: {e}") from None
        if said > MOST_RECORD and said != zstd.CONTENTSIZE_UNKNOWN:
            raise ValueError("a record is too long")
        one, out, size = reader.decompressobj(), [], 0
        while True:
            try:
                out.append(one.decompress(data))
            except zstd.ZstdError as e:
                raise ValueError(f"a frame is damaged: {e}") from None
            size += len(out[-1])
            if size > MOST_RECORD:
                raise ValueError("a record is too long")
            if one.eof:
                data = one.unused_data
                break
            if not (data := f.read(1 << 16)):
                raise ValueError("the archive ends inside a frame")
        if said not in (size, zstd.CONTENTSIZE_UNKNOWN):
            raise ValueError("a frame's length isn't what it says")
        yield b"".join(out)


def parsed(data: bytes) -> dict:
    """One record, checked: its headers, payload, and what they say of it."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name in headers:
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name] = value.strip()
    if missing := [k for k in NEEDED if k not in headers]:
        raise ValueError(f"no header {missing[0]}")
    if not headers["Content-Length"].isascii() or not headers["Content-Length"].isdigit():
        raise ValueError("Content-Length isn't a number")
    n = int(headers["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block isn't as long as Content-Length says, or what follows isn't two line ends")
    if (said := headers.get("WARC-Block-Digest")) and said != f"sha256:{sha256(block)}":
        raise ValueError("the block's digest is wrong")
    kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if kind not in ("response", "revisit"):
        return {"headers": headers, "type": kind, "payload": block, "bytes": n, "digest": digest or sha256(block)}
    http, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.partition(b":")[::2] for x in http.split(b"\r\n")[1:])
    size = int(fields.get(b"Content-Length", b"-1"))
    if not mark or kind == "response" and (size != len(payload) or digest and digest != sha256(payload)) or kind == "revisit" and (payload or "WARC-Refers-To" not in headers):
        raise ValueError("the payload isn't what its headers say")
    return {"headers": headers, "type": kind, "payload": payload, "bytes": size, "digest": digest or sha256(payload)}


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives; with payloads False, their bytes are checked but not returned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, n in chain.from_iterable(zip(b["path"], b["records"], strict=True) for b in batches):
            rows, size, seen = [], 0, 0

            def frame(rows: list) -> pd.DataFrame:
                out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                return out.assign(page_id=pd.array(out["page_id"], "Int64"), refers_to=pd.array(out["refers_to"], "Int64"))

            with files.reading(path) as (f, _):
                for data in frames(f):
                    r = parsed(data)
                    h = r["headers"]
                    rows.append((page_of(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), r["bytes"], r["digest"], r["type"], page_of(h.get("WARC-Refers-To")), r["payload"] if payloads else None))
                    seen, size = seen + 1, size + (len(data) if payloads else 500)
                    if size >= 16 << 20:
                        yield frame(rows)
                        rows, size = [], 0
            if seen != n:
                raise ValueError(f"{path} has {seen} records; {n} were written")
            if rows:
                yield frame(rows)

    return manifest.repartition(max(1, manifest.count()), "path").mapInPandas(run, READ)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    return read(write(pages, scratch_path(pages.sparkSession, "warc")), payloads)
