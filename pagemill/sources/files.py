"""Scans of files into pages: images, TIFF, CSV and native HTML; manifests, dictionaries, and documents that need a converter."""

from __future__ import annotations

import io
import json
import math
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import images
from pagemill.functions.text import file_extension
from pagemill.operators.codecs import csv_html

#: The suffixes that documents may have.
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".ppm", ".pgm", ".tga")
PAGED = (".tif", ".tiff", ".pdf")
CONVERTED = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".rtf", ".odt", ".ods", ".odp", ".html", ".htm", ".epub", ".ofd")
EXTENSIONS = (*IMAGES, *PAGED, *CONVERTED, ".csv")
#: Read here without an external program.
NATIVE = (".png", ".bmp", ".ppm", ".pgm", ".tga", ".tif", ".tiff")

PAGES = "path string, page int, width int, height int, rgb binary, error string"


def supported(path: Column) -> Column:
    return file_extension(path).isin(*EXTENSIONS)


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, ext, length and content of the files below folder; unsupported ones are left out before their bytes are read."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return t.where(supported(F.col("path"))).select("path", file_extension(F.col("path")).alias("ext"), "length", "content")


def image_pages(files: DataFrame, limits: images.Limits | None = None) -> DataFrame:
    """One row for each page of image files (path, content): packed RGB, or an error."""
    limits = limits or images.Limits()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, k, p.shape[1], p.shape[0], p.tobytes(), None) for k, p in enumerate(images.decode(bytes(content), limits), 1)]
                except ValueError as e:
                    rows = [(path, 1, None, None, None, str(e))]
                out = pd.DataFrame(rows, columns=["path", "page", "width", "height", "rgb", "error"])
                yield out.assign(width=pd.array(out["width"], "Int32"), height=pd.array(out["height"], "Int32"))

    return files.select("path", "content").mapInPandas(run, PAGES)


def jpeg_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of JPEG files by Spark's image reader, whose bytes are BGR."""

    @F.pandas_udf("binary")
    def to_rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        flip = lambda d, n: np.frombuffer(d, np.uint8).reshape(-1, n)[:, [2, 1, 0] if n >= 3 else [0, 0, 0]].tobytes()
        return pd.Series([flip(bytes(d), n) for d, n in zip(data, channels, strict=True)])

    t = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", "*.jp*g").load(folder).select("image.*")
    return t.select(F.col("origin").alias("path"), F.lit(1).alias("page"), "width", "height", to_rgb("data", "nChannels").alias("rgb"), F.lit(None).cast("string").alias("error"))


def csv_tables(files: DataFrame, delimiter: str = ",") -> DataFrame:
    """path, html and error of CSV files (path, content)."""

    @F.pandas_udf("html string, error string")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append((csv_html(bytes(c), delimiter), None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["html", "error"])

    return files.select("path", run("content").alias("t")).select("path", "t.*")


def pdf_plan(info: Column, dpi: int = 150, max_pages: int = 1000, max_pixels: int = 40_000_000) -> Column:
    """What to render, from the text that a PDF inspector prints: pages, scale_to (longest edge, or null), error.

    Pixels of a page are points * dpi / 72; scale_to only applies where a page would have more than max_pixels.
    """
    pages = F.regexp_extract(info, r"(?m)^Pages:\s+(\d+)", 1).try_cast("int")
    sizes = F.regexp_extract_all(info, F.lit(r"(?m)^Page(?:\s+\d+)? size:\s+([0-9.]+) x ([0-9.]+)"), F.lit(0))
    edge = lambda s, k: F.regexp_extract(s, r"size:\s+([0-9.]+) x ([0-9.]+)", k).try_cast("double") * dpi / 72
    longest = F.array_max(F.transform(sizes, lambda s: F.greatest(edge(s, 1), edge(s, 2))))
    cap = math.isqrt(max_pixels)
    error = F.when(pages.isNull() | (pages < 1), "no page count").when(pages > max_pages, "too many pages")
    return F.struct(pages.alias("pages"), F.when(longest > cap, F.lit(cap)).alias("scale_to"), error.alias("error"))


#: Tags of native HTML blocks and their types.
HTML_TAGS = (("h1", "title"), ("h2", "heading"), ("h3", "heading"), ("p", "text"), ("footer", "footer"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks (doc_id, source_index, type, text) of HTML (doc_id, html) without rendering: headings and paragraphs in order, tags taken out."""
    names = "|".join(tag for tag, _ in HTML_TAGS)
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(rf"(?is)<({names})>(.*?)</(?:{names})>"), F.lit(0))
    t = pages.select("doc_id", F.posexplode(found).alias("at", "raw"))
    kinds = F.create_map(*(F.lit(x) for pair in HTML_TAGS for x in pair))
    kind = kinds[F.lower(F.regexp_extract("raw", rf"(?is)^<({names})>", 1))]
    return t.select("doc_id", F.col("at").cast("bigint").alias("source_index"), kind.alias("type"), F.regexp_replace("raw", "(?s)<[^>]*>", "").alias("text"))


#: Where packed documents keep their text, and the tags of a paragraph and of a heading there.
PACKED = {".docx": (r"word/document\.xml", "p", None), ".odt": (r"content\.xml", "p", "h"), ".odp": (r"content\.xml", "p", "h"), ".pptx": (r"ppt/slides/slide\d+\.xml", "p", None), ".epub": (r".*\.x?html?", "p", "h1")}
MOST_PART = 64 << 20
BLOCKS = "path string, source_index bigint, type string, text string, error string"


def packed_text(content: bytes, ext: str) -> list[tuple[str, str]]:
    """Type and text of the paragraphs of a packed document, part by part in order of their names' numbers, or of an EPUB's spine."""
    part, paragraph, heading = PACKED[ext]
    local = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    with zipfile.ZipFile(io.BytesIO(content)) as z:

        def parsed(name: str) -> ElementTree.Element:
            if z.getinfo(name).file_size > MOST_PART:
                raise ValueError(f"{name} is too large")
            data = z.read(name)
            if b"<!ENTITY" in data:
                raise ValueError(f"{name} declares entities")
            return ElementTree.fromstring(data)

        names = [n for n in z.namelist() if re.fullmatch(part, n)]
        if ext == ".epub":
            (book,) = [n for n in z.namelist() if n.endswith(".opf")][:1] or [None]
            if book is None:
                raise ValueError("an EPUB without a package")
            root = parsed(book)
            files = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(book), e.get("href", ""))) for e in root.iter() if local(e) == "item"}
            names = [files[e.get("idref")] for e in root.iter() if local(e) == "itemref" and files.get(e.get("idref")) in z.namelist()]
        else:
            names.sort(key=lambda n: [int(d) for d in re.findall(r"\d+", n)])
        out = []
        for name in names:
            for e in parsed(name).iter():
                if local(e) in (paragraph, heading) and (text := "".join(e.itertext()).strip()):
                    out.append(("title" if local(e) == heading else "text", text))
        return out


def packed_blocks(files: DataFrame) -> DataFrame:
    """Text blocks of Word, presentation, OpenDocument and EPUB files (path, ext, content) without rendering, or an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ext, content in zip(batch["path"], batch["ext"], batch["content"], strict=True):
                try:
                    rows = [(path, k, kind, text, None) for k, (kind, text) in enumerate(packed_text(bytes(content), ext))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(path, None, None, None, f"the document is damaged: {e}")]
                out = pd.DataFrame(rows, columns=["path", "source_index", "type", "text", "error"])
                yield out.assign(source_index=pd.array(out["source_index"], "Int64"))

    return files.where(F.col("ext").isin(*PACKED)).select("path", "ext", "content").mapInPandas(run, BLOCKS)


def needs_converter(files: DataFrame) -> DataFrame:
    """path and error of files that only an external program can render; there is none here."""
    return files.where(~F.col("ext").isin(*NATIVE, *PACKED, ".csv", ".jpg", ".jpeg", ".html", ".htm")).select("path", F.concat(F.lit("no converter for "), F.col("ext")).alias("error"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Batch jobs (job_id, input, output, priority) of a JSON manifest: an array, or an object with jobs. Paths are relative to it."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ValueError(f"the manifest isn't JSON: {e}") from None
    jobs = data.get("jobs") if isinstance(data, dict) else data
    if not isinstance(jobs, list):
        raise ValueError("the manifest has no jobs")
    base, rows = posixpath.dirname(path), []
    for k, job in enumerate(jobs):
        unknown = set(job) - {"input", "output", "priority"} if isinstance(job, dict) else {"?"}
        if unknown or not isinstance(job.get("input"), str) or not isinstance(job.get("output"), str):
            raise ValueError(f"job {k} isn't an input and an output")
        priority = job.get("priority", 0)
        if not isinstance(priority, int) or isinstance(priority, bool) or abs(priority) > 1_000_000:
            raise ValueError(f"job {k}'s priority isn't an integer within a million")
        rows.append((k, posixpath.join(base, job["input"]), posixpath.join(base, job["output"]), priority))
    return spark.createDataFrame(rows, "sequence bigint, input string, output string, priority int")


def read_vocabulary(spark: SparkSession, path: str, most: int = 1_000_000) -> list[str]:
    """Tokens of a dictionary file, one a line."""
    lines = [r[0].removesuffix("\r") for r in spark.read.text(path, wholetext=False).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError("the dictionary is too long")
    return lines
