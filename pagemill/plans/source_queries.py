"""Queries over names, inspector texts, pixels, polygons, and the whole layout pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import images as I
from pagemill.functions.text import file_extension
from pagemill.operators import jobs as J
from pagemill.operators import layout as L
from pagemill.plans.pipeline import Pipeline
from pagemill.sources import files
from pagemill.sources.views import LAYOUT_BOXES_SQL, PAGE_HEIGHT, PAGE_WIDTH, layout_boxes, table

SUFFIXES = (".PNG", ".pdf", ".Docx", ".txt", ".ofd", ".csv", ".gz", "", ".TIFF", ".html")
ASSETS = ("page-1.png", "a/b.png", "..png", "x.PNG", "a\\b.png", "p q.png")


def supported_extension(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    path = F.concat(F.lit("in.d/"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int")))
    return t.select("doc_id", file_extension(path).alias("ext"), files.supported(path).alias("supported"))


def id_checks(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    n = F.col("doc_id") % 6
    job = F.when(n == 0, h).when(n == 1, F.upper(h)).when(n == 2, F.concat(h, h, F.lit("0"))).when(n == 3, F.lit("")).when(n == 4, F.lit("xyz")).otherwise(F.concat(h, h))
    asset = F.element_at(F.array(*map(F.lit, ASSETS)), (n + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", J.valid_job_id(job).alias("job"), J.valid_asset(asset).alias("asset"))


def pdf_plan(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 1300).alias("n"), (F.col("o_custkey") % 3000 + 100).alias("w"))
    info = F.concat(F.lit("Title: Pages: 7\nPages:          "), F.when(F.col("n") % 10 != 9, F.col("n").cast("string")).otherwise(F.lit("?")), F.lit("\nPage    1 size: "), F.col("w").cast("string"), F.lit(" x 612.5 pts (letter)\nPage    2 size: 300 x "), (F.col("w") + 50).cast("string"), F.lit(" pts\n"))
    return t.select("doc_id", files.pdf_plan(info).alias("p")).select("doc_id", "p.*")


def pixel_operators(spark: SparkSession, d: str) -> DataFrame:
    """Four by four pixels of each embedding: turned, whitened, halved, as planes, and whether their bytes fit a size."""
    listed = lambda a: ",".join(str(int(v)) for v in np.asarray(a).ravel())

    @F.pandas_udf("rotated string, white string, half string, planes string, consistent boolean")
    def run(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
        rows = []
        for p, w in zip(pixels, width, strict=True):
            image = np.array(p, np.uint8).reshape(4, 4, 3)
            planes = I.tensor(image, 4, 4, scale=1 / 256, mean=(0.5, 0.5, 0.5), std=(0.25, 0.25, 0.25)) * 64
            rows.append((listed(I.rotate(image, 90)), listed(I.white_out(image, [(0.5, 1.2, 2.1, 2.9)])), listed(I.resize(image, 2, 2)), listed(planes), I.consistent(image.tobytes(), int(w), 4)))
        return pd.DataFrame(rows, columns=["rotated", "white", "half", "planes", "consistent"])

    pixels = F.transform(F.slice("embedding", 1, 48), lambda v: (F.floor(F.abs(v.cast("double")) * 1000) % 256).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", run(pixels, (F.col("vec_id") % 2 + 4).cast("int")).alias("r")).select("vec_id", "r.*")


def polygon_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a polygon detector, flat and nested, some of two points only."""
    t = layout_boxes(spark, d)
    c = [F.col(s).cast("string") for s in ("x0", "y0", "x1", "y1")]
    ring = [(0, 1), (2, 1), (2, 3), (0, 3)]
    pair = lambda k: F.concat(c[ring[k][0]], F.lit(","), c[ring[k][1]])
    nested = F.concat(F.lit("[["), F.array_join(F.array(*map(pair, range(4))), "],["), F.lit("]]"))
    flat = F.concat(F.lit("["), F.array_join(F.array(*map(pair, range(4))), ","), F.lit("]"))
    two = F.concat(F.lit("["), pair(0), F.lit(","), pair(2), F.lit("]"))
    points = F.when(F.col("source_index") == 4, two).when(F.col("source_index") % 2 == 0, nested).otherwise(flat)
    item = F.concat(F.lit('{"label":"'), F.col("type"), F.lit('","score":'), F.col("score").cast("string"), F.lit(',"polygon_points":'), points, F.when(F.col("source_index") % 3 == 2, F.lit(',"order":null}')).otherwise(F.lit("}")))
    rows = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source_index", item.alias("item")))).alias("items"))
    answers = rows.select("doc_id", F.lit(1).alias("page"), F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), F.concat(F.lit('{"boxes":['), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("]}")).alias("response"))
    return L.from_polygon_boxes(answers).select("doc_id", "source_index", "raw_type", "x0", "y0", "x1", "y1", "score", "reading_order", F.size("polygon").cast("bigint").alias("points"), "error")


CONFIG = {
    "version": 1, "models": {"finder": {"backend": "mock"}, "reader": {"backend": "mock", "response": "hi"}, "bad": {"backend": "mock", "fails": "HTTP 503"}},
    "layout": {"model": "finder", "provider": "paddle", "score_threshold": 0.3}, "routes": {"header": {"action": "skip"}, "figure": {"models": ["bad"]}, "*": {"models": ["bad", "reader"]}}, "execution": {"on_error": "record"},
}


def pipeline_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents by the layout pipeline: skipped and failing regions, an empty second page for some, invalid boxes in others."""
    t = layout_boxes(spark, d)
    x0 = F.when((F.col("doc_id") % 17 == 0) & (F.col("source_index") == 0), F.lit(1200.0)).otherwise(F.col("x0"))
    item = F.concat(F.lit('{"label":"'), F.col("type"), F.lit('","score":'), F.col("score").cast("string"), F.lit(',"coordinate":['), F.concat_ws(",", x0.cast("string"), *(F.col(s).cast("string") for s in ("y0", "x1", "y1"))), F.lit("]}"))
    rows = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source_index", item.alias("item")))).alias("items"))
    answer = F.concat(F.lit('{"boxes":['), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("]}"))
    page = lambda rows, n, response: rows.select("doc_id", F.lit(n).alias("page"), F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), response.alias("response"))
    answers = page(rows, 1, answer).unionByName(page(rows.where("doc_id % 5 = 0"), 2, F.lit('{"boxes":[]}')))
    out = Pipeline(CONFIG).documents(answers)
    good = F.when(F.col("status") == "succeeded", F.col("markdown"))
    return out.select("doc_id", "status", "exit_code", "document_error", F.regexp_count("json", F.lit('"page":')).cast("bigint").alias("pages"), good.alias("markdown"))


QUERIES = {
    "q_supported_extension": supported_extension, "q_id_checks": id_checks, "q_pdf_plan": pdf_plan, "q_pixel_operators": pixel_operators, "q_polygon_boxes": polygon_boxes, "q_pipeline_documents": pipeline_documents,
}

_PIXEL = "px[cast({} as int)]"

SQL = {
    "q_supported_extension": f"""
with t as (select doc_id, 'in.d/' || doc_id || ({list(SUFFIXES)!r})[cast(doc_id % {len(SUFFIXES)} + 1 as int)] as path from documents),
e as (select doc_id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as ext from t)
select doc_id, ext, ext in ('.png', '.jpg', '.jpeg', '.bmp', '.ppm', '.pgm', '.tga', '.tif', '.tiff', '.pdf', '.doc', '.docx', '.ppt', '.pptx', '.xls', '.xlsx', '.rtf', '.odt', '.ods', '.odp', '.html', '.htm', '.epub', '.ofd', '.csv') as supported from e""",
    "q_id_checks": "select doc_id, doc_id % 6 in (0, 5) as job, doc_id % 6 in (0, 5) as asset from documents",
    "q_pdf_plan": """
with t as (select o_orderkey as doc_id, case when o_orderkey % 1300 % 10 <> 9 then o_orderkey % 1300 end as n, o_custkey % 3000 + 100 as w from orders),
l as (select doc_id, n, greatest(w * 150e0 / 72, 612.5e0 * 150 / 72, 300 * 150e0 / 72, (w + 50) * 150e0 / 72) as longest from t)
select doc_id, cast(n as int) as pages, cast(case when longest > 6324 then 6324 end as int) as scale_to,
  case when n is null or n < 1 then 'no page count' when n > 1000 then 'too many pages' end as error from l""",
    "q_pixel_operators": f"""
with p as (select vec_id, [cast(floor(abs(cast(v as double)) * 1000) as int) % 256 for v in embedding[1 : 48]] as px from embeddings)
select vec_id, array_to_string([{_PIXEL.format('((j // 3) % 4 * 4 + 3 - j // 12) * 3 + j % 3 + 1')} for j in range(48)], ',') as rotated,
  array_to_string([case when (j // 3) % 4 < 3 and j // 12 in (1, 2) then 255 else {_PIXEL.format('j + 1')} end for j in range(48)], ',') as white,
  array_to_string([cast(floor(({' + '.join(_PIXEL.format(f'((2 * (j // 6) + {y}) * 4 + 2 * ((j // 3) % 2) + {x}) * 3 + j % 3 + 1') for y in (0, 1) for x in (0, 1))}) / 4e0 + 0.5e0) as int) for j in range(12)], ',') as half,
  array_to_string([{_PIXEL.format('(j % 16) * 3 + j // 16 + 1')} - 128 for j in range(48)], ',') as planes, vec_id % 2 = 0 as consistent from p""",
    "q_polygon_boxes": f"""with {LAYOUT_BOXES_SQL},
c as (select *, least(x0, 1100e0) as a, least(y0, 1400e0) as b, least(x1, 1100e0) as c, least(y1, 1400e0) as d from boxes)
select doc_id, source_index, type as raw_type, a as x0, b as y0, c as x1, d as y1, score, cast(case when source_index % 3 <> 2 then source_index end as int) as reading_order,
  cast(case when source_index = 4 then 2 else 4 end as bigint) as points,
  case when source_index = 4 then 'polygon of too few, too many or odd numbers' when abs((c - a) * (d - b)) < 1e-6 then 'degenerate polygon' end as error from c""",
    "q_pipeline_documents": f"""with {LAYOUT_BOXES_SQL},
m as (select *, doc_id % 17 = 0 and source_index = 0 as bad from boxes),
k as (select * from m where bad or score >= 0.3e0),
e as (select distinct doc_id from boxes),
s as (select doc_id, bool_or(bad) as failed, bool_or(type = 'figure' and not bad) as recorded,
    string_agg(case when bad or type = 'header' then '' when type = 'figure' then '**[OCR block failed]**' || chr(10) || chr(10)
      when type = 'title' then '# hi' || chr(10) || chr(10) when type = 'formula' then '$$' || chr(10) || 'hi' || chr(10) || '$$' || chr(10) || chr(10) else 'hi' || chr(10) || chr(10) end, '' order by source_index) as body
  from k group by doc_id)
select doc_id, case when failed then 'failed' else 'succeeded' end as status, cast(case when failed then 1 when recorded then 2 else 0 end as int) as exit_code,
  case when failed then 'empty after clamping' end as document_error, cast(case when doc_id % 5 = 0 then 2 else 1 end as bigint) as pages,
  case when not coalesce(failed, false) then '<!-- page: 1 -->' || chr(10) || chr(10) || coalesce(body, '') || case when doc_id % 5 = 0 then '<!-- page: 2 -->' || chr(10) || chr(10) else '' end end as markdown
from e left join s using (doc_id)""",
}
