"""Box post-processing on tables keyed by (doc_id, page): filters, overlap elimination, containment, composites, order.

Overlaps, forests and composites gather a page's boxes in one row (a page has at most max_boxes of them), work on the array
and write the boxes out again, so boxes are shuffled once by (doc_id, page) and not again by the next step. Errors are columns,
not exceptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.geometry import SIDES, area, clamp, contains, intersection, iou, rect

PAGE = ["doc_id", "page"]
#: Types that are dropped, outer types of composites, and types that open them.
HEADER_FOOTER = ("header", "footer", "page_header", "page_footer", "ignored_header", "ignored_footer")
OUTER, EXPAND = ("chart", "figure", "table"), ("table", "formula", "equation", "title", "heading")
#: Strongest first.
LABEL_PRIORITY = ("table", "chart", "figure", "title", "heading", "formula", "equation", "text", "header", "page_header", "footer", "page_footer")


def with_type(boxes: DataFrame, type_map: dict[str, str]) -> DataFrame:
    """type by the alias map of raw_type, which stays as it is."""
    pairs = [F.lit(x) for kv in type_map.items() for x in kv]
    alias = F.create_map(*pairs)[F.col("raw_type")] if pairs else F.lit(None)
    return boxes.withColumn("type", F.coalesce(alias, "raw_type"))


def clamped(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    w, h = width.cast("double"), height.cast("double")
    return boxes.withColumns({s: clamp(F.col(s), 0.0, w if s[0] == "x" else h) for s in SIDES})


def scaled(boxes: DataFrame, x: Column, y: Column) -> DataFrame:
    return boxes.withColumns({s: F.col(s) * (x if s[0] == "x" else y) for s in SIDES})


def geometry_error(width: Column, height: Column) -> Column:
    """Why a box is unusable, in the order of the checks; null for a good one."""
    r = rect()
    finite = None
    for v in r:
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        finite = ok if finite is None else finite & ok
    w, h = width.cast("double"), height.cast("double")
    flat = (clamp(r[2], 0.0, w) <= clamp(r[0], 0.0, w)) | (clamp(r[3], 0.0, h) <= clamp(r[1], 0.0, h))
    return (
        F.when(~finite, "coordinates not finite")
        .when(~F.coalesce(F.col("score").between(0.0, 1.0) & ~F.isnan("score"), F.lit(False)), "score out of range")
        .when(~F.coalesce(F.col("rotation").isin(0, 90, 180, 270), F.lit(False)), "rotation not a right angle")
        .when(flat, "empty after clamping")
    )


def page_error(boxes: DataFrame, max_boxes: int = 2000) -> DataFrame:
    """boxes with page_error, where a page has more boxes than allowed."""
    n = F.count("*").over(Window.partitionBy(*PAGE))
    return boxes.withColumn("page_error", F.when(n > max_boxes, F.lit("too many boxes")))


def low_score(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    return boxes.where(F.col("score") >= threshold)


def header_footer(boxes: DataFrame, types: tuple[str, ...] = HEADER_FOOTER) -> DataFrame:
    return boxes.where(~F.col("type").isin(*types))


def ordered(boxes: DataFrame, alias: str = "position") -> DataFrame:
    """position: from 0 in reading order, boxes without one last, then by source_index."""
    w = Window.partitionBy(*PAGE).orderBy(F.col("reading_order").asc_nulls_last(), "source_index")
    return boxes.withColumn(alias, F.row_number().over(w) - 1)


def dense_index(boxes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Boxes that reach the threshold, source_index counted anew; a missing order takes that count."""
    w = Window.partitionBy(*PAGE).orderBy("source_index")
    kept = boxes.where(F.col("score") >= threshold).withColumn("source_index", (F.row_number().over(w) - 1).cast("bigint"))
    return kept.withColumn("reading_order", F.coalesce("reading_order", F.col("source_index").cast("int"))) if "reading_order" in boxes.columns else kept


def _sided(boxes: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return boxes.select(*PAGE, *(F.col(c).alias(f"{side}_{c}") for c in columns))


def iou_pairs(boxes: DataFrame, threshold: float = 0.5, order: str = "source_index", columns: tuple[str, ...] = ("source_index", "type", "score")) -> DataFrame:
    """Pairs a, b of boxes of a page, a before b by order, of IoU at least threshold."""
    some = list(dict.fromkeys([order, *columns, *SIDES]))
    a, b = _sided(boxes, "a", some), _sided(boxes, "b", some)
    # The cheap rectangle test goes first: it needs no division.
    meet = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    pairs = a.join(b, PAGE).where((F.col(f"a_{order}") < F.col(f"b_{order}")) & (meet if threshold > 0 else F.lit(True)))
    return pairs.withColumn("iou", iou(rect("a_"), rect("b_"))).where(F.col("iou") >= threshold)


def priority(kind: Column, labels: tuple[str, ...] = LABEL_PRIORITY) -> Column:
    """Larger is stronger, 0 for an unlisted label."""
    at = F.array_position(F.array(*map(F.lit, labels)), kind)
    return F.when(at > 0, len(labels) + 1 - at).otherwise(0)


def wins(a: Column | None = None, b: Column | None = None, margin: float = 0.3, labels: tuple[str, ...] = LABEL_PRIORITY) -> Column:
    """Of two boxes, structs or columns a_ and b_: a clear score difference decides, then the label, the score, the index."""
    one = lambda side, x, c: F.col(f"{side}_{c}") if x is None else x[c]
    (sa, ta, ia), (sb, tb, ib) = (tuple(one(side, x, c) for c in ("score", "type", "source_index")) for side, x in (("a", a), ("b", b)))
    pa, pb = priority(ta, labels), priority(tb, labels)
    return F.when((F.abs(sa - sb) + 1e-9 >= margin) & (sa != sb), sa > sb).when(pa != pb, pa > pb).when(sa != sb, sa > sb).otherwise(ia < ib)


def gathered(boxes: DataFrame, *order: Column) -> DataFrame:
    """One row a page with rows, an array of its boxes' structs by order, then source_index."""
    rest = [c for c in boxes.columns if c not in (*PAGE, "source_index")]
    keys = [o.alias(f"_o{k}") for k, o in enumerate(order)]
    return boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*keys, "source_index", *rest))).alias("rows"))


def scattered(pages: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The boxes of rows again, each with the columns that more gives for a box `box` at place `at`."""
    out = pages.select("*", F.posexplode("rows").alias("at", "box"))
    return out.select(*(F.col(c) if c in PAGE else F.col(f"box.{c}") for c in columns), *more)


def corners(box: Column) -> tuple[Column, ...]:
    return tuple(box[s] for s in SIDES)


def removed_by_overlap(rows: Column, threshold: float = 0.5, margin: float = 0.3, labels: tuple[str, ...] = LABEL_PRIORITY, related: Callable[[Column, Column], Column] | None = None) -> Column:
    """Places in rows, an ordered array of boxes, of those that lose a conflict of overlap.

    Conflicts are taken in the order of their places; one whose sides are both still there removes the loser. Boxes for which
    related holds don't conflict.
    """

    def with_later(a: Column, i: Column) -> Column:
        def meets(b: Column, j: Column) -> Column:
            # The rectangle test needs no division and rules most pairs out.
            near = (j > i) & (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
            both = near & (iou(corners(a), corners(b)) >= threshold)
            return both if related is None else both & ~F.coalesce(related(a, b), F.lit(False))

        found = F.transform(rows, lambda b, j: F.when(meets(b, j), F.struct(i.alias("i"), j.alias("j"), F.when(wins(a, b, margin, labels), j).otherwise(i).alias("loser"))))
        return F.filter(found, lambda p: p.isNotNull())

    conflicts = F.flatten(F.transform(rows, with_later))
    lost = lambda gone, p: F.array_contains(gone, p["i"]) | F.array_contains(gone, p["j"])
    return F.aggregate(conflicts, F.array().cast("array<int>"), lambda gone, p: F.when(lost(gone, p), gone).otherwise(F.array_append(gone, p["loser"])))


def without_overlaps(boxes: DataFrame, **options) -> DataFrame:
    """boxes (with reading_order) without those that lose a conflict of overlap."""
    pages = gathered(boxes, F.col("reading_order").isNull(), F.col("reading_order"))
    pages = pages.withColumn("gone", F.when(F.size("rows") > 1, removed_by_overlap(F.col("rows"), **options)).otherwise(F.array().cast("array<int>")))
    kept = pages.withColumn("rows", F.filter("rows", lambda r, i: ~F.array_contains("gone", i)))
    return scattered(kept, boxes.columns)


def parents_of(rows: Column, share: float = 0.9) -> Column:
    """For each box of rows the source_index of the smallest box that contains it, then the first; null without one."""

    def parent(a: Column) -> Column:
        outer = F.filter(rows, lambda b: (b["source_index"] != a["source_index"]) & contains(corners(b), corners(a), share))
        return F.array_min(F.transform(outer, lambda b: F.struct(area(corners(b)).alias("area"), b["source_index"].alias("at"))))["at"]

    return F.transform(rows, parent)


#: The chain of ancestors of each box, nearest first, walked over the page's links of children with their parents.
CHAINS = """
    transform(up, p -> IF(p IS NULL, cast(array() as array<bigint>),
      aggregate(sequence(1, cardinality(links)), named_struct('at', p, 'out', cast(array() as array<bigint>)),
        (a, i) -> IF(a.at IS NULL, a, named_struct('at', try_element_at(links, a.at), 'out', array_append(a.out, a.at))),
        a -> a.out)))"""


def trees(boxes: DataFrame, share: float = 0.9) -> DataFrame:
    """One row a page: rows, and aligned with them up (parents) and above (ancestors, nearest first); inner: all parents."""
    pages = gathered(boxes).withColumn("up", parents_of(F.col("rows"), share))
    pages = pages.withColumn("links", F.map_from_entries(F.filter(F.transform("rows", lambda r, i: F.struct(r["source_index"].alias("child"), F.get("up", i).alias("parent"))), lambda e: e["parent"].isNotNull())))
    return pages.withColumn("above", F.expr(CHAINS)).withColumn("inner", F.map_values("links")).drop("links")


def forest(boxes: DataFrame, share: float = 0.9) -> DataFrame:
    """boxes with parent, ancestors, nearest first, and children, the number of direct children."""
    children = F.size(F.filter("inner", lambda p: p == F.col("box.source_index"))).alias("children")
    return scattered(trees(boxes, share), boxes.columns, F.get("up", "at").alias("parent"), F.get("above", "at").alias("ancestors"), children)


SEMANTIC = "array_distinct(flatten(transform(filter(arrays_zip(rows, above), z -> z.rows.type IN ({})), z -> z.above)))"


def listed(names: tuple[str, ...]) -> str:
    return ", ".join("'" + n.replace("'", "\\'") + "'" for n in names)


def semantic_ancestors(boxes: DataFrame, expand: tuple[str, ...] = EXPAND, share: float = 0.9) -> DataFrame:
    """(doc_id, page, source_index) of boxes that hold one of an expand type at any depth."""
    return trees(boxes, share).select(*PAGE, F.explode(F.expr(SEMANTIC.format(listed(expand)))).alias("source_index"))


def composites(boxes: DataFrame, outer: tuple[str, ...] = OUTER, expand: tuple[str, ...] = EXPAND, share: float = 0.9, least_score: float = 0.7, inspect: bool = False) -> DataFrame:
    """boxes after composite handling, with parent_source_index and composite_children (or provisional_children).

    An outer box with children is kept if its score is high enough and nothing below it is of an expand type; else it goes and
    its direct children name it. What lies below a kept outer box is listed by the nearest one, and goes unless inspect.
    """
    pages = trees(boxes, share).withColumn("semantic", F.expr(SEMANTIC.format(listed(expand))))
    pages = pages.withColumn("holders", F.expr(f"filter(rows, r -> r.type IN ({listed(outer)}) AND array_contains(inner, r.source_index))"))
    good = lambda r: (r["score"] >= least_score) & ~F.array_contains("semantic", r["source_index"])
    index = lambda r: r["source_index"]
    pages = pages.withColumns({"retained": F.transform(F.filter("holders", good), index), "gone": F.transform(F.filter("holders", lambda r: ~good(r)), index)})
    pages = pages.withColumn("holder", F.transform("above", lambda a: F.get(F.filter(a, lambda x: F.array_contains("retained", x)), F.lit(0))))
    box, mine = F.col("box.source_index"), F.expr("array_sort(transform(filter(arrays_zip(rows, holder), z -> z.holder = box.source_index), z -> z.rows.source_index))")
    name = "provisional_children" if inspect else "composite_children"
    freed = F.when(F.array_contains("gone", F.get("up", "at")), F.get("up", "at")).alias("parent_source_index")
    stays = ~F.array_contains("gone", box) & (F.lit(True) if inspect else F.get("holder", "at").isNull())
    out = scattered(pages, boxes.columns, freed, F.when(F.size(mine) > 0, mine).alias(name), stays.alias("_stays"))
    return out.where("_stays").drop("_stays")


def masks(boxes: DataFrame, outer: tuple[str, ...] = OUTER) -> DataFrame:
    """Rectangles of outer boxes with children, from boxes of forest()."""
    return boxes.where(F.col("type").isin(*outer) & (F.col("children") > 0)).select(*PAGE, *(F.col(s).alias(f"m_{s}") for s in SIDES))


def recovered(boxes: DataFrame, found: DataFrame, masked: DataFrame, threshold: float = 0.3, ignored: tuple[str, ...] = HEADER_FOOTER, occluded: float = 0.2, most: int = 100) -> DataFrame:
    """boxes with those of found (a second layout pass over masked pages) that are new, numbered on from the largest index."""
    good = found.where((F.col("score") >= threshold) & ~F.col("type").isin(*ignored)).withColumn("a", area(rect())).where("a > 0")
    hidden = good.select(*PAGE, "source_index", "a", *SIDES).join(masked, PAGE).where(intersection(rect(), rect("m_")) / F.col("a") >= occluded)
    good = good.drop("a").join(masked.select(*PAGE).distinct(), PAGE, "left_semi").join(hidden.select(*PAGE, "source_index").distinct(), [*PAGE, "source_index"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy("source_index"))
    top = boxes.groupBy(*PAGE).agg(F.max("source_index").alias("top"))
    good = good.withColumn("rank", rank).where(F.col("rank") <= most).join(top, PAGE)
    good = good.withColumn("source_index", F.col("top") + F.col("rank")).drop("rank", "top").withColumn("recovered", F.lit(True))
    return boxes.withColumn("recovered", F.lit(False)).unionByName(good)


FINAL = "array<struct<position:int,source_index:bigint,area:double,text:string,error:string,children:array<bigint>>>"


def finalised(regions: DataFrame, uncovered: bool = True, least_bytes: int = 4) -> DataFrame:
    """Regions after recognition: provisional children expand or are covered, parents in order of falling area.

    regions has position, text, error, provisional_children. A page's regions are gathered (at most max_boxes) and folded
    over its parents: an inner text that the outer lacks drops the outer and frees its children; else the children go.
    """
    rows = regions.where("provisional_children is not null or text is not null").groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct("position", "source_index", area(rect()).alias("area"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("error", F.lit("")).alias("error"), F.coalesce("provisional_children", F.array().cast("array<bigint>")).alias("children")))).cast(FINAL).alias("rows")
    )
    low = lambda x: f"translate(regexp_replace({x}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shows = f"(p.text = '' OR p.error <> '' OR ({str(uncovered).lower()} AND NOT contains({low('p.text')}, {low('c.text')})))"
    state = f"""
      aggregate(array_sort(filter(rows, r -> size(r.children) > 0), (a, b) -> CASE WHEN a.area > b.area THEN -1 WHEN a.area < b.area THEN 1 WHEN a.position < b.position THEN -1 ELSE 1 END),
        named_struct('gone', cast(array() as array<bigint>), 'freed', cast(array() as array<struct<child:bigint,parent:bigint>>), 'listed', cast(array() as array<struct<parent:bigint,child:bigint>>)),
        (s, p) -> IF(array_contains(s.gone, p.source_index), s,
          aggregate(array(filter(rows, c -> c.source_index <> p.source_index AND array_contains(p.children, c.source_index) AND NOT array_contains(s.gone, c.source_index))), s,
            (t, alive) -> IF(exists(alive, c -> c.error = '' AND octet_length(c.text) >= {least_bytes} AND {shows}),
              named_struct('gone', array_append(t.gone, p.source_index), 'freed', concat(t.freed, transform(alive, c -> named_struct('child', c.source_index, 'parent', p.source_index))), 'listed', t.listed),
              named_struct('gone', concat(t.gone, transform(alive, c -> c.source_index)), 'freed', t.freed, 'listed', concat(t.listed, transform(alive, c -> named_struct('parent', p.source_index, 'child', c.source_index))))))))"""
    # Only pages with a parent need the fold.
    folded = rows.where(F.exists("rows", lambda r: F.size(r["children"]) > 0)).select(*PAGE, F.expr(state).alias("s"))
    out = regions.join(folded, PAGE, "left").where(F.col("s").isNull() | ~F.array_contains("s.gone", F.col("source_index")))
    freed = F.element_at(F.filter("s.freed", lambda f: f["child"] == F.col("source_index")), -1)["parent"]
    freed = F.when(F.exists("s.freed", lambda f: f["child"] == F.col("source_index")), freed)
    mine = F.transform(F.filter("s.listed", lambda f: f["parent"] == F.col("source_index")), lambda f: f["child"])
    return out.withColumn("parent_source_index", freed).withColumn("composite_children", F.when(F.size(mine) > 0, mine)).drop("s", "provisional_children")
