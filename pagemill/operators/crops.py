"""Crops of regions from page images: each page's pixels travel once, with all its boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import images as I
from pagemill.operators.boxes import PAGE
from pagemill.operators.models import CROPPERS

CROP = "doc_id bigint, page int, source_index bigint, crop binary, crop_error string"


def pixels(width: int, height: int, rgb: bytes) -> np.ndarray:
    if not I.consistent(rgb, width, height):
        raise ValueError("pixels and page size differ")
    return np.frombuffer(rgb, np.uint8).reshape(height, width, 3)


def cropped(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """PNG crops (doc_id, page, source_index, crop, crop_error) of regions, turned upright.

    regions: doc_id, page, source_index, corners, rotation, cropper, fallback, polygon (or null); pages: doc_id, page, width,
    height, rgb. A region without its page's pixels has an error.
    """
    box = F.struct("source_index", "x0", "y0", "x1", "y1", "rotation", "cropper", "fallback", "polygon")
    gathered = regions.groupBy(*PAGE).agg(F.collect_list(box).alias("boxes"))
    t = gathered.join(pages.select(*PAGE, "width", "height", "rgb"), PAGE, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = []
                for b in r.boxes:
                    try:
                        if r.rgb is None:
                            raise ValueError("no page image")
                        points = [(p["x"], p["y"]) for p in b["polygon"]] if b["polygon"] is not None else None
                        image = CROPPERS.get(b["cropper"])(pixels(int(r.width), int(r.height), bytes(r.rgb)), (b["x0"], b["y0"], b["x1"], b["y1"]), points, b["fallback"])
                        rows.append((r.doc_id, r.page, b["source_index"], I.encode_png(I.rotate(image, int(b["rotation"] or 0))), None))
                    except ValueError as e:
                        rows.append((r.doc_id, r.page, b["source_index"], None, str(e)))
                yield pd.DataFrame(rows, columns=["doc_id", "page", "source_index", "crop", "crop_error"])

    return t.mapInPandas(run, CROP)


def encoded(pages: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """pages (doc_id, page, width, height) with image: PNG of their pixels, areas of masks (doc_id, page, m_x0 ... m_y1) white."""
    t = pages.select(*PAGE, "width", "height", "rgb")
    if masks is not None:
        area = F.array(*(F.col(f"m_{s}") for s in ("x0", "y0", "x1", "y1")))
        t = t.join(masks.groupBy(*PAGE).agg(F.collect_list(area).alias("areas")), PAGE)
    else:
        t = t.withColumn("areas", F.array().cast("array<array<double>>"))

    @F.pandas_udf("binary")
    def png(width: pd.Series, height: pd.Series, rgb: pd.Series, areas: pd.Series) -> pd.Series:
        return pd.Series([I.encode_png(I.white_out(pixels(int(w), int(h), bytes(p)), [tuple(b) for b in a])) for w, h, p, a in zip(width, height, rgb, areas, strict=True)])

    return t.select(*PAGE, "width", "height", png("width", "height", "rgb", "areas").alias("image"))
