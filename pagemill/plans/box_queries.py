"""Queries over boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import boxes as B
from pagemill.sources.views import LAYOUT_BOXES_SQL, PAGE_HEIGHT, PAGE_WIDTH, layout_boxes

TYPE_MAP = {"chart": "figure", "header": "page_header", "formula": "equation"}
MATRIX = (2.0, 0.0, -4.0, 0.0, 2.0, -6.0, 0.0, 0.0, 1.0)
CORNERS = ("x0", "y0", "x1", "y1")


def type_map(spark: SparkSession, d: str) -> DataFrame:
    return B.with_type(layout_boxes(spark, d), TYPE_MAP).select("doc_id", "source_index", "raw_type", "type")


def clamp_scale(spark: SparkSession, d: str) -> DataFrame:
    x = B.scaled(layout_boxes(spark, d), F.lit(2.0), F.lit(0.5))
    return B.clamped(x, F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT)).select("doc_id", "source_index", *CORNERS)


def validate_boxes(spark: SparkSession, d: str) -> DataFrame:
    t = layout_boxes(spark, d).withColumn("rotation", (F.col("doc_id") % 5 * 90).cast("int")).withColumn("score", F.col("score") + F.when(F.col("doc_id") % 13 == 0, 0.5).otherwise(0.0))
    t = t.withColumn("x0", F.when(F.col("doc_id") % 17 == 0, F.lit(1200.0)).otherwise(F.col("x0")))
    t = B.page_error(t.withColumn("error", B.geometry_error(F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))), 6)
    return t.select("doc_id", "source_index", "error", "page_error")


def low_score(spark: SparkSession, d: str) -> DataFrame:
    return B.low_score(layout_boxes(spark, d)).select("doc_id", "source_index", "score")


def header_footer(spark: SparkSession, d: str) -> DataFrame:
    return B.header_footer(layout_boxes(spark, d)).select("doc_id", "source_index", "type")


def dense_source_index(spark: SparkSession, d: str) -> DataFrame:
    t = layout_boxes(spark, d).withColumn("reading_order", F.when(F.col("source_index") % 3 != 2, F.col("reading_order")))
    return B.dense_index(t, 0.5).select("doc_id", "source_index", "type", "score", "reading_order")


def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return B.iou_pairs(layout_boxes(spark, d)).select("doc_id", "a_source_index", "b_source_index", "iou")


def overlap_winner(spark: SparkSession, d: str) -> DataFrame:
    return B.iou_pairs(layout_boxes(spark, d), 0.3).select("doc_id", "a_source_index", "b_source_index", B.wins().alias("a_wins"))


def overlap_dedup(spark: SparkSession, d: str) -> DataFrame:
    return B.without_overlaps(layout_boxes(spark, d)).select("doc_id", "source_index", "type", "score")


def containment_parent(spark: SparkSession, d: str) -> DataFrame:
    return B.forest(layout_boxes(spark, d)).select("doc_id", "source_index", "parent", F.col("children").cast("bigint").alias("children"))


def ancestor_closure(spark: SparkSession, d: str) -> DataFrame:
    t = B.forest(layout_boxes(spark, d))
    return t.select("doc_id", "source_index", F.posexplode("ancestors").alias("depth", "ancestor")).withColumn("depth", (F.col("depth") + 1).cast("bigint"))


def semantic_descendant(spark: SparkSession, d: str) -> DataFrame:
    return B.semantic_ancestors(layout_boxes(spark, d)).select("doc_id", "source_index")


def composite_keep(spark: SparkSession, d: str) -> DataFrame:
    t = B.composites(B.header_footer(B.low_score(layout_boxes(spark, d))))
    return t.select("doc_id", "source_index", "type", "parent_source_index", F.array_join(F.transform("composite_children", lambda x: x.cast("string")), ",").alias("composite_children"))


def recovered_filter(spark: SparkSession, d: str) -> DataFrame:
    t = layout_boxes(spark, d).drop("raw_type", "reading_order")
    moved = t.withColumn("x0", F.col("x0") + 300).withColumn("x1", F.col("x1") + 300)
    masked = B.masks(B.forest(t))
    return B.recovered(t, moved, masked, most=3).select("doc_id", "source_index", "type", "x0", "score", "recovered")


def composite_finalize(spark: SparkSession, d: str) -> DataFrame:
    t = B.ordered(B.composites(layout_boxes(spark, d), expand=("equation",), least_score=0.0, inspect=True))
    n = (F.col("doc_id") + F.col("source_index")) % 5
    t = t.withColumn("text", F.when(F.col("provisional_children").isNotNull(), F.concat(F.lit("Words w0 W1\nw2 w3"), F.lit(""))).otherwise(F.concat(F.lit("w"), n.cast("string"), F.lit(" w"), (n + 1).cast("string"))))
    t = t.withColumn("error", F.when(F.col("source_index") == 3, F.lit("failed")).otherwise(F.lit("")))
    out = B.finalised(t.drop("parent_source_index"))
    return out.select("doc_id", "source_index", "type", "parent_source_index", F.array_join(F.transform(F.array_sort("composite_children"), lambda x: x.cast("string")), ",").alias("composite_children"))


def homography(spark: SparkSession, d: str) -> DataFrame:
    x, y = G.homography(F.col("x0"), F.col("y0"), MATRIX)
    return layout_boxes(spark, d).select("doc_id", "source_index", G.clamp(x, 0.0, 1100.0).alias("x"), G.clamp(y, 0.0, 1400.0).alias("y"))


def _polygon() -> F.Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = G.rect()
    return F.array(point(x0, y0), point(x1, y0 + 10), point(x1 - 10, y1), point(x0, y1))


def polygon_area(spark: SparkSession, d: str) -> DataFrame:
    t = layout_boxes(spark, d).withColumn("polygon", _polygon())
    return t.select("doc_id", "source_index", G.signed_area(F.col("polygon")).alias("signed_area"), G.bounds(F.col("polygon"))["x1"].alias("right"))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    t = layout_boxes(spark, d).withColumn("polygon", _polygon())
    return t.select("doc_id", "source_index", G.in_polygon(F.lit(300.5), F.lit(400.5), F.col("polygon")).alias("inside"))


def crop_rectangle(spark: SparkSession, d: str) -> DataFrame:
    r = tuple(F.col(s) / 3 - 20 for s in CORNERS)
    return layout_boxes(spark, d).select("doc_id", "source_index", G.crop_rectangle(r, F.lit(300), F.lit(300)).alias("r")).select("doc_id", "source_index", "r.*")


QUERIES = {
    "q_type_map": type_map, "q_clamp_scale": clamp_scale, "q_validate_boxes": validate_boxes, "q_low_score": low_score, "q_header_footer": header_footer,
    "q_dense_source_index": dense_source_index, "q_iou_pairs": iou_pairs, "q_overlap_winner": overlap_winner, "q_overlap_dedup": overlap_dedup,
    "q_containment_parent": containment_parent, "q_ancestor_closure": ancestor_closure, "q_semantic_descendant": semantic_descendant, "q_composite_keep": composite_keep,
    "q_recovered_filter": recovered_filter, "q_composite_finalize": composite_finalize, "q_homography": homography, "q_polygon_area": polygon_area,
    "q_point_in_polygon": point_in_polygon, "q_crop_rectangle": crop_rectangle,
}

_BOTH = "greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "((({0}.x1 - {0}.x0)) * ({0}.y1 - {0}.y0))"
_IOU = f"({_BOTH}) / ({_AREA.format('a')} + {_AREA.format('b')} - ({_BOTH}))"
_PRIORITY = "(case when list_position({0}, {1}.type) > 0 then {2} - list_position({0}, {1}.type) else 0 end)"
_RANK = {s: _PRIORITY.format(list(B.LABEL_PRIORITY), s, len(B.LABEL_PRIORITY) + 1) for s in "ab"}
_WINS = f"""case when abs(a.score - b.score) + 1e-9 >= 0.3e0 and a.score <> b.score then a.score > b.score
    when {_RANK['a']} <> {_RANK['b']} then {_RANK['a']} > {_RANK['b']} when a.score <> b.score then a.score > b.score else a.source_index < b.source_index end"""
PAIRS_SQL = f"""
pairs as (
  select a.doc_id, a.source_index as i, b.source_index as j, {_IOU} as iou, {_WINS} as a_wins
  from boxes a join boxes b on a.doc_id = b.doc_id and a.source_index < b.source_index)"""
_PARENTS = f"""
inside as (
  select a.doc_id, a.source_index, b.source_index as outer_index, {_AREA.format('b')} as size
  from boxes a join boxes b on a.doc_id = b.doc_id and a.source_index <> b.source_index
  where {_AREA.format('b')} > 1.05e0 * {_AREA.format('a')} and ({_BOTH}) / {_AREA.format('a')} >= 0.9e0),
parents as (select doc_id, source_index, arg_min(outer_index, (size, outer_index)) as parent from inside group by all),
closure(doc_id, source_index, ancestor, depth) as (
  select doc_id, source_index, parent, 1 from parents
  union all select c.doc_id, c.source_index, p.parent, c.depth + 1 from closure c join parents p on c.doc_id = p.doc_id and c.ancestor = p.source_index),
kids as (select doc_id, parent as source_index, count(*) as children from parents group by all)"""
_WITH = f"with recursive {LAYOUT_BOXES_SQL}"
_COMPOSITE = """
semantic as (select distinct c.doc_id, c.ancestor as source_index from closure c join boxes b on b.doc_id = c.doc_id and b.source_index = c.source_index where b.type in {expand}),
flagged as (
  select b.*, coalesce(k.children, 0) > 0 and b.type in ('chart', 'figure', 'table') as holds, b.score >= {least} and s.source_index is null as good
  from boxes b left join kids k using (doc_id, source_index) left join semantic s using (doc_id, source_index)),
held as (
  select c.doc_id, c.source_index, arg_min(c.ancestor, c.depth) as holder
  from closure c join flagged f on f.doc_id = c.doc_id and f.source_index = c.ancestor where f.holds and f.good group by all),
listed as (select doc_id, holder as source_index, list(source_index order by source_index) as kids from held group by all),
tagged as (select p.doc_id, p.source_index, p.parent from parents p join flagged f on f.doc_id = p.doc_id and f.source_index = p.parent where f.holds and not f.good)"""

SQL = {
    "q_type_map": f"{_WITH} select doc_id, source_index, type as raw_type, case type when 'chart' then 'figure' when 'header' then 'page_header' when 'formula' then 'equation' else type end as type from boxes",
    "q_clamp_scale": f"{_WITH} select doc_id, source_index, least(x0 * 2, 1100e0) as x0, least(y0 * 0.5e0, 1400e0) as y0, least(x1 * 2, 1100e0) as x1, least(y1 * 0.5e0, 1400e0) as y1 from boxes",
    "q_validate_boxes": f"""{_WITH},
v as (select doc_id, source_index, case when doc_id % 17 = 0 then 1200e0 else x0 end as x0, x1, score + case when doc_id % 13 = 0 then 0.5e0 else 0e0 end as score, doc_id % 5 * 90 as rotation from boxes)
select doc_id, source_index, case when score > 1 then 'score out of range' when rotation not in (0, 90, 180, 270) then 'rotation not a right angle' when least(x1, 1100e0) <= least(x0, 1100e0) then 'empty after clamping' end as error,
  case when count(*) over (partition by doc_id) > 6 then 'too many boxes' end as page_error from v""",
    "q_low_score": f"{_WITH} select doc_id, source_index, score from boxes where score >= 0.3e0",
    "q_header_footer": f"{_WITH} select doc_id, source_index, type from boxes where type <> 'header'",
    "q_dense_source_index": f"""{_WITH},
k as (select doc_id, row_number() over (partition by doc_id order by source_index) - 1 as n, source_index, type, score from boxes where score >= 0.5e0)
select doc_id, n as source_index, type, score, cast(case when source_index % 3 <> 2 then source_index else n end as int) as reading_order from k""",
    "q_iou_pairs": f"{_WITH}, {PAIRS_SQL} select doc_id, i as a_source_index, j as b_source_index, iou from pairs where iou >= 0.5e0",
    "q_overlap_winner": f"{_WITH}, {PAIRS_SQL} select doc_id, i as a_source_index, j as b_source_index, a_wins from pairs where iou >= 0.3e0",
    "q_overlap_dedup": f"""{_WITH}, {PAIRS_SQL},
n as (select doc_id, i, j, case when a_wins then j else i end as loser, row_number() over (partition by doc_id order by i, j) as k from pairs where iou >= 0.5e0),
fold(doc_id, k, gone) as (
  select distinct doc_id, cast(0 as bigint), cast([] as bigint[]) from n
  union all select f.doc_id, n.k, case when list_contains(f.gone, n.i) or list_contains(f.gone, n.j) then f.gone else list_append(f.gone, n.loser) end from fold f join n on n.doc_id = f.doc_id and n.k = f.k + 1),
last as (select doc_id, arg_max(gone, k) as gone from fold group by doc_id)
select doc_id, source_index, type, score from boxes left join last using (doc_id) where gone is null or not list_contains(gone, source_index)""",
    "q_containment_parent": f"{_WITH}, {_PARENTS} select b.doc_id, b.source_index, p.parent, coalesce(k.children, 0) as children from boxes b left join parents p using (doc_id, source_index) left join kids k using (doc_id, source_index)",
    "q_ancestor_closure": f"{_WITH}, {_PARENTS} select doc_id, source_index, cast(depth as bigint) as depth, ancestor from closure",
    "q_semantic_descendant": f"{_WITH}, {_PARENTS} select distinct c.doc_id, c.ancestor as source_index from closure c join boxes b on b.doc_id = c.doc_id and b.source_index = c.source_index where b.type in {B.EXPAND}",
    "q_composite_keep": f"""with recursive {LAYOUT_BOXES_SQL.replace('boxes as', 'every as', 1)}, boxes as (select * from every where score >= 0.3e0 and type <> 'header'),
{_PARENTS}, {_COMPOSITE.format(expand=B.EXPAND, least='0.7e0')}
select f.doc_id, f.source_index, f.type, t.parent as parent_source_index, list_aggregate(l.kids, 'string_agg', ',') as composite_children
from flagged f left join held h using (doc_id, source_index) left join listed l using (doc_id, source_index) left join tagged t using (doc_id, source_index)
where h.holder is null and not (f.holds and not f.good)""",
    "q_recovered_filter": f"""{_WITH}, {_PARENTS},
mask as (select b.* from boxes b join kids using (doc_id, source_index) where type in ('chart', 'figure', 'table')),
moved as (select doc_id, source_index, type, x0 + 300 as x0, y0, x1 + 300 as x1, y1, score from boxes where score >= 0.3e0 and type <> 'header'),
fresh as (
  select a.*, row_number() over (partition by a.doc_id order by a.source_index) as k from moved a
  where exists (select 1 from mask b where b.doc_id = a.doc_id) and not exists (select 1 from mask b where b.doc_id = a.doc_id and ({_BOTH}) / {_AREA.format('a')} >= 0.2e0))
select doc_id, source_index, type, x0, score, false as recovered from boxes
union all select doc_id, k + (select max(source_index) from boxes b where b.doc_id = fresh.doc_id), type, x0, score, true from fresh where k <= 3""",
    "q_homography": f"{_WITH} select doc_id, source_index, greatest(0e0, least(1100e0, (x0 * 2 - 4) / 1e0)) as x, greatest(0e0, least(1400e0, (y0 * 2 - 6) / 1e0)) as y from boxes",
    "q_polygon_area": f"{_WITH} select doc_id, source_index, ((x0 * (y0 + 10) - x1 * y0) + (x1 * y1 - (x1 - 10) * (y0 + 10)) + ((x1 - 10) * y1 - x0 * y1) + (x0 * y0 - x0 * y1)) / 2 as signed_area, x1 as right from boxes",
    "q_point_in_polygon": f"""{_WITH},
e as (select doc_id, source_index, unnest([(x0, y0, x0, y1), (x1, y0 + 10, x0, y0), (x1 - 10, y1, x1, y0 + 10), (x0, y1, x1 - 10, y1)]) as s from boxes),
c as (select doc_id, source_index, s[1] as px, s[2] as py, s[3] as qx, s[4] as qy from e)
select doc_id, source_index, sum(case when (py > 400.5e0) <> (qy > 400.5e0) and 300.5e0 < (qx - px) * (400.5e0 - py) / (qy - py) + px then 1 else 0 end) % 2 = 1 as inside from c group by all""",
    "q_crop_rectangle": f"""{_WITH},
r as (select doc_id, source_index, least(300e0, greatest(0e0, x0 / 3 - 20)) as x0, least(300e0, greatest(0e0, y0 / 3 - 20)) as y0, least(300e0, greatest(0e0, x1 / 3 - 20)) as x1, least(300e0, greatest(0e0, y1 / 3 - 20)) as y1 from boxes),
p as (select doc_id, source_index, cast(floor(x0) as bigint) as x0, cast(floor(y0) as bigint) as y0, cast(ceil(x1) as bigint) as x1, cast(ceil(y1) as bigint) as y1 from r)
select doc_id, source_index, case when x1 > x0 and y1 > y0 then x0 end as x0, case when x1 > x0 and y1 > y0 then y0 end as y0, case when x1 > x0 and y1 > y0 then x1 end as x1, case when x1 > x0 and y1 > y0 then y1 end as y1 from p""",
}
