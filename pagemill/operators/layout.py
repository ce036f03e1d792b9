"""Detector answers to boxes: JSON adapters, layout tokens and layout tensors. A bad item becomes a row with an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.geometry import SIDES, bounds, clamp, homography, signed_area
from pagemill.operators.boxes import geometry_error

#: Label and corner keys, and the corners' unit, by adapter.
ADAPTERS = {"paddle": ("label", "coordinate", "pixel"), "pixel": ("type", "bbox", "pixel"), "normalized": ("type", "bbox", "normalized")}
ITEMS = "struct<res:struct<boxes:array<string>>,boxes:array<string>>"


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: filters behind it can't be pushed before it and compute it again."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def items(answers: DataFrame) -> DataFrame:
    """One row (answers' columns, at, item) for each box of a JSON response, wrapped in `res` or not."""
    parsed = F.from_json("response", ITEMS)
    return answers.select(*(c for c in answers.columns if c != "response"), F.posexplode(F.coalesce(parsed["res"]["boxes"], parsed["boxes"])).alias("at", "item"))


def order_of(item: Column, given: Column, default: Column) -> Column:
    """(order, reading_order): a missing order takes the default and is read; null keeps the default but isn't read."""
    missing = given.isNull() & ~F.array_contains(F.json_object_keys(item), "order")
    return F.struct(F.coalesce(given, default.cast("int")).alias("order"), F.when(missing, default.cast("int")).otherwise(given).alias("reading_order"))


def from_json_boxes(answers: DataFrame, adapter: str = "paddle", threshold: float = 0.0, type_map: dict[str, str] | None = None) -> DataFrame:
    """Boxes of answers (doc_id, page, width, height, response): checked, clamped, filtered, with dense source_index."""
    label, corners, unit = ADAPTERS[adapter]
    t = settled(items(answers), "j", F.from_json("item", f"{label} string, {corners} array<double>, score double, rotation int, `order` int"))
    given = F.col(f"j.{corners}")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    for i, s in enumerate(SIDES):
        v = F.get(given, F.lit(i))
        t = t.withColumn(s, v * (w if i % 2 == 0 else h) if unit == "normalized" else v)
    t = t.withColumn("score", F.coalesce("j.score", F.lit(1.0))).withColumn("rotation", F.coalesce("j.rotation", F.lit(0))).withColumn("raw_type", F.col(f"j.{label}"))
    error = F.when(F.col("raw_type").isNull(), F.lit(f"no {label}")).otherwise(geometry_error(F.col("width"), F.col("height")))
    t = t.withColumn("error", error).where(F.col("error").isNotNull() | (F.col("score") >= threshold))
    kept = Window.partitionBy("doc_id", "page", F.col("error").isNull()).orderBy("at")
    t = t.withColumn("source_index", F.when(F.col("error").isNull(), F.row_number().over(kept) - 1).cast("bigint"))
    t = t.withColumn("o", order_of(F.col("item"), F.col("j.order"), F.coalesce("source_index", F.col("at").cast("bigint"))))
    for i, s in enumerate(SIDES):
        t = t.withColumn(s, clamp(F.col(s), 0.0, w if i % 2 == 0 else h))
    pairs = [F.lit(x) for kv in (type_map or {}).items() for x in kv]
    kind = F.coalesce(F.create_map(*pairs)[F.col("raw_type")], "raw_type") if pairs else F.col("raw_type")
    return t.select("doc_id", "page", "source_index", kind.alias("type"), "raw_type", *SIDES, "score", "rotation", "o.order", "o.reading_order", "error")


def from_polygon_boxes(answers: DataFrame, matrix: tuple[float, ...] = (1, 0, 0, 0, 1, 0, 0, 0, 1), threshold: float = 0.0) -> DataFrame:
    """Boxes of a polygon detector: raw source_index, polygon and corners mapped by a homography to the page.

    polygon_points may be flat or nested, of 3 to 4096 points. Without a coordinate the polygon's bounds are the box; where
    they differ, crop_bbox is the union of both.
    """
    t = items(answers)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")

    def mapped(x: Column, y: Column) -> Column:
        px, py = homography(x, y, matrix)
        return F.struct(clamp(px, 0.0, w).alias("x"), clamp(py, 0.0, h).alias("y"))

    # Steps are columns, so that no list is read anew for each of its numbers.
    t = settled(t, "j", F.from_json("item", "label string, score double, `order` int, coordinate array<double>, polygon_points string"))
    t = settled(t, "numbers", F.transform(F.split(F.regexp_replace("j.polygon_points", r"[\[\]\s]", ""), ","), lambda v: v.try_cast("double")))
    numbers, count = F.col("numbers"), F.floor(F.size("numbers") / 2).cast("int")
    points = F.when(F.size(numbers) >= 2, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: mapped(F.get(numbers, 2 * i), F.get(numbers, 2 * i + 1))))
    t = settled(t, "polygon", points).withColumn("n", F.when(F.col("polygon").isNotNull(), F.size(numbers)))
    c = F.col("j.coordinate")
    at = [F.get(c, F.lit(i)) for i in range(4)]
    corners = F.when(F.size(c) == 4, bounds(F.array(*(mapped(at[i], at[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))))))
    t = settled(settled(t, "hull", F.when(F.col("polygon").isNotNull(), bounds(F.col("polygon")))), "box", F.coalesce(corners, F.col("hull")))
    t = t.withColumn("score", F.coalesce("j.score", F.lit(1.0))).withColumn("raw_type", F.col("j.label"))
    error = (
        F.when(F.col("box").isNull(), "no coordinate and no polygon")
        .when((F.size(c) == 4) & ((at[2] <= at[0]) | (at[3] <= at[1])), "empty coordinate")
        .when((F.col("n") % 2 == 1) | (F.col("n") < 6) | (F.col("n") > 8192), "polygon of too few, too many or odd numbers")
        .when(F.abs(signed_area(F.col("polygon"))) < 1e-6, "degenerate polygon")
        .when(~F.col("score").between(0.0, 1.0), "score out of range")
    )
    union = F.struct(F.least("box.x0", "hull.x0").alias("x0"), F.least("box.y0", "hull.y0").alias("y0"), F.greatest("box.x1", "hull.x1").alias("x1"), F.greatest("box.y1", "hull.y1").alias("y1"))
    t = settled(t, "error", error).withColumn("crop_bbox", F.when(F.col("hull").isNotNull() & (union != F.col("box")), union))
    t = t.withColumn("o", order_of(F.col("item"), F.col("j.order"), F.col("at"))).where(F.col("error").isNotNull() | (F.col("score") >= threshold))
    return t.select("doc_id", "page", F.col("at").cast("bigint").alias("source_index"), "raw_type", "box.*", "score", "polygon", "crop_bbox", "o.order", "o.reading_order", "error")


TOKEN = r"<\|box_start\|>\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*<\|box_end\|>\s*<\|ref_start\|>([^<]*)<\|ref_end\|>\s*(?:<\|rotate_(up|right|down|left)\|>)?"


def from_tokens(answers: DataFrame) -> DataFrame:
    """Boxes of layout token texts: corners in thousandths of the page, a rotation mark behind."""
    found = F.regexp_extract_all("response", F.lit(TOKEN), F.lit(0))
    starts = F.regexp_count("response", F.lit(r"<\|box_start\|>"))
    bad = F.when((F.size(found) == 0) & (F.trim("response") != ""), "not layout tokens").when(starts != F.size(found), "some layout tokens can't be read")
    t = answers.withColumn("page_error", bad).select("doc_id", "page", "width", "height", "page_error", F.posexplode_outer(F.when(bad.isNull(), found)).alias("at", "item")).where("item is not null or page_error is not null")
    n = [F.regexp_extract("item", TOKEN, i + 1).try_cast("bigint") for i in range(4)]
    over = F.greatest(*n) > 1000
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    x, y = (n[0] * w / 1000, n[2] * w / 1000), (n[1] * h / 1000, n[3] * h / 1000)
    turn = F.regexp_extract("item", TOKEN, 6)
    rotation = F.when(turn == "right", 90).when(turn == "down", 180).when(turn == "left", 270).otherwise(0)
    return t.select(
        "doc_id", "page", F.col("at").cast("bigint").alias("source_index"), F.regexp_extract("item", TOKEN, 5).alias("raw_type"),
        F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"), rotation.alias("rotation"),
        F.coalesce("page_error", F.when(over, F.lit("coordinate over 1000"))).alias("error"),
    )


def from_tensor(tensors: DataFrame, labels: tuple[str, ...], threshold: float = 0.5, x_scale: float = 1.0, y_scale: float = 1.0) -> DataFrame:
    """Boxes of [N, 6] tensors (class, score, corners) in data, scaled to the page; classes without a label are errors."""
    n = F.floor(F.size("data") / 6).cast("int")
    rows = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("data", i * 6 + 1, 6)))
    t = tensors.select("id", F.posexplode(rows).alias("at", "r"))
    v = [F.get("r", F.lit(i)).cast("double") for i in range(6)]
    t = t.select("id", F.col("at").cast("bigint").alias("source_index"), F.floor(v[0]).cast("int").alias("class"), v[1].alias("score"), (v[2] * x_scale).alias("x0"), (v[3] * y_scale).alias("y0"), (v[4] * x_scale).alias("x1"), (v[5] * y_scale).alias("y1"))
    names = F.array(*map(F.lit, labels))
    t = t.withColumn("type", F.when((F.col("class") >= 0) & (F.col("class") < len(labels)), F.get(names, F.col("class"))))
    return t.withColumn("error", F.when(F.col("type").isNull(), F.lit("class without a label"))).where(F.col("score") >= threshold)
