"""Queries over pages, regions, codecs and whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import boxes as B
from pagemill.operators import codecs as C
from pagemill.operators import layout as L
from pagemill.operators import regions as R
from pagemill.plans.box_queries import PAIRS_SQL
from pagemill.sources.files import html_blocks as blocks_of_html
from pagemill.sources.views import CONVERSATION_SQL, LAYOUT_BOXES_SQL, PAGE_TABLES_SQL, conversation_blocks, conversation_pages, layout_boxes, page_tables, table

CORNERS = ("x0", "y0", "x1", "y1")
ROUTES = (("table", "recognize", ["t1", "t2"]), ("figure", "image", []), ("header", "skip", []), ("chart", "save_crop", []), ("*", "recognize", ["m1"]))


def _routes(spark: SparkSession, rows=ROUTES) -> DataFrame:
    return spark.createDataFrame(list(rows), R.ROUTES)


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return B.ordered(conversation_blocks(spark, d)).select("doc_id", "source_index", "reading_order", F.col("position").cast("bigint").alias("position"))


def route_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = R.routed(layout_boxes(spark, d), _routes(spark, [r for r in ROUTES if r[0] != "*"]))
    return t.select("doc_id", "source_index", "type", "action", F.array_join("models", ",").alias("models"), "save_crop", "route_error")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Model a answers labelled documents, model b those with text, unless their id is a multiple of seven."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    a = labels.select("doc_id", F.lit("a").alias("model"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("response"), F.lit(None).cast("string").alias("error"))
    b = docs.select("doc_id", F.lit("b").alias("model"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("response"), F.when(F.col("doc_id") % 7 == 0, F.lit("HTTP 503")).alias("error"))
    return a.unionByName(b)


def _tried(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("source_index"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("models"))
    return R.first_success(docs, _answers(spark, d), ["doc_id"])


def fallback(spark: SparkSession, d: str) -> DataFrame:
    return _tried(spark, d).select("doc_id", "model", "text", "error")


def error_policy(spark: SparkSession, d: str) -> DataFrame:
    t = _tried(spark, d).withColumn("doc_id", F.floor(F.col("doc_id") / 10)).withColumn("page", F.lit(1))
    a, b = R.document_status(t, "record"), R.document_status(t, "fail")
    out = a.select("doc_id", "blocks", "failed_blocks", F.col("exit_code").alias("record_code")).join(b.select("doc_id", "status", F.col("exit_code").alias("fail_code")), "doc_id")
    return out.select("doc_id", "blocks", "failed_blocks", "record_code", "status", "fail_code")


def cross_page_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.page_links(page_tables(spark, d)).select("doc_id", F.col("page").cast("bigint").alias("page"), "joins")


def cross_page_merge(spark: SparkSession, d: str) -> DataFrame:
    t = R.stitched(page_tables(spark, d))
    pages = F.array_join(F.transform("merged_pages", lambda p: p.cast("string")), ",")
    return t.select("doc_id", F.col("page").cast("bigint").alias("page"), pages.alias("merged_pages"), F.col("merged_into.page").cast("bigint").alias("merged_into"), F.md5(F.col("text").cast("binary")).alias("digest"))


def simple_table_parse(spark: SparkSession, d: str) -> DataFrame:
    t = page_tables(spark, d).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))
    rows = T.table_rows(F.col("text"))
    return t.select("doc_id", F.col("page").cast("bigint").alias("page"), T.is_table(F.col("text")).alias("is_table"), F.size(rows).cast("bigint").alias("rows"), T.columns_of(F.get(rows, F.lit(0))).cast("bigint").alias("columns"))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    return n.select("n_regionkey", F.array_join(F.transform("n", lambda x: F.concat(F.lit("<fcel>"), x["n_nationkey"].cast("string"), F.lit("<fcel>"), x["n_name"], F.lit(" & <nl>"))), "").alias("tokens"))


def otsl_html(spark: SparkSession, d: str) -> DataFrame:
    t = _nations(spark, d).withColumn("tokens", F.regexp_replace("tokens", " & ", "&"))
    return t.select("n_regionkey", C.otsl_plain(F.col("tokens")).alias("html"))


def otsl_spans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables in tokens with a cell of two rows and columns; those of keys divisible by three are broken."""
    t = table(spark, d, "orders")
    tokens = F.concat(F.lit("<fcel>"), F.col("o_orderpriority"), F.lit("<lcel><nl><ucel><xcel><nl><fcel>"), F.col("o_orderkey").cast("string"), F.lit("<ecel><nl>"))
    tokens = F.when(F.col("o_orderkey") % 3 == 0, F.lit("<fcel>A<nl><xcel><nl>")).otherwise(tokens)
    return t.select("o_orderkey", C.otsl_html_column(tokens).alias("t")).select("o_orderkey", F.col("t.value").alias("html"), F.col("t.error").isNotNull().alias("failed"))


def csv_strict(spark: SparkSession, d: str) -> DataFrame:
    quote = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.coalesce("text", F.lit(""))
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("id,lang,text\n"), F.col("doc_id").cast("string"), F.lit(","), F.col("lang"), F.lit(","), quote(text), F.lit("\n")).alias("csv"))
    t = t.withColumn("csv", F.when(F.col("doc_id") % 10 == 3, F.concat("csv", F.lit('a"b'))).otherwise(F.col("csv")))
    return t.select("doc_id", C.csv_html_column(F.col("csv")).alias("t")).select("doc_id", F.md5(F.col("t.value").cast("binary")).alias("digest"), F.col("t.error").isNotNull().alias("failed"))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Headings and paragraphs of raw pages, tags taken out, in order."""
    return blocks_of_html(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html"))


def layout_json(spark: SparkSession, d: str) -> DataFrame:
    """Boxes written as a detector's JSON and read back; every fifth has no order, every seventh a null one."""
    t = layout_boxes(spark, d)
    order = F.when(F.col("source_index") % 5 == 4, F.lit("")).when(F.col("source_index") % 7 == 6, F.lit(',"order":null')).otherwise(F.concat(F.lit(',"order":'), (F.col("source_index") * 2).cast("string")))
    item = F.concat(F.lit('{"label":"'), F.col("type"), F.lit('","score":'), F.col("score").cast("string"), F.lit(',"coordinate":['), F.concat_ws(",", *(F.col(c).cast("string") for c in CORNERS)), F.lit("]"), order, F.lit("}"))
    rows = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source_index", item.alias("item")))).alias("items"))
    wrapped = F.concat(F.lit('{"res":{"boxes":['), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("]}}"))
    plain = F.concat(F.lit('{"boxes":['), F.array_join(F.transform("items", lambda i: i["item"]), ","), F.lit("]}"))
    answers = rows.select("doc_id", F.lit(1).alias("page"), F.lit(1100).alias("width"), F.lit(1400).alias("height"), F.when(F.col("doc_id") % 2 == 0, wrapped).otherwise(plain).alias("response"))
    out = L.from_json_boxes(answers, "paddle", 0.5, {"chart": "figure"})
    return out.select("doc_id", "source_index", "type", "raw_type", *CORNERS, "score", "order", "reading_order", "error")


def mineru_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = layout_boxes(spark, d).select("doc_id", "source_index", "type", F.col("x0").cast("bigint").alias("a"), F.col("y0").cast("bigint").alias("b"))
    turn = F.when(F.col("a") % 3 == 0, "<|rotate_right|>").when(F.col("a") % 3 == 1, "<|rotate_up|>").otherwise("")
    item = F.concat(F.lit("<|box_start|>"), F.concat_ws(" ", (F.col("a") + 100).cast("string"), F.col("b").cast("string"), F.col("a").cast("string"), (F.col("b") + 201).cast("string")), F.lit("<|box_end|><|ref_start|>"), F.col("type"), F.lit("<|ref_end|>"), turn)
    rows = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source_index", item.alias("item")))).alias("items"))
    answers = rows.select("doc_id", F.lit(1).alias("page"), F.lit(2000).alias("width"), F.lit(500).alias("height"), F.array_join(F.transform("items", lambda i: i["item"]), "\n").alias("response"))
    return L.from_tokens(answers).select("doc_id", "source_index", "raw_type", *CORNERS, "rotation", "error")


VOCABULARY = ("", "a", "b", "c", "d", "e", "f", "g")


def ctc_decode(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").select("vec_id", C.ctc_steps(F.col("embedding"), 8).alias("best"))
    return t.select("vec_id", F.array_join(F.transform("best", lambda s: s.cast("string")), "").alias("steps"), C.ctc_text(F.col("best"), F.array(*map(F.lit, VOCABULARY))).alias("text"))


def tensor_layout(spark: SparkSession, d: str) -> DataFrame:
    scaled = F.transform(F.concat("embedding", F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")), lambda v, i: F.when(i % 6 == 0, F.floor(F.abs(v) * 40).cast("double")).otherwise(F.abs(v.cast("double"))))
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), scaled.alias("data"))
    out = L.from_tensor(t, ("text", "table", "figure", "title"), 0.1, 10.0, 5.0)
    return out.select(F.col("id").alias("vec_id"), "source_index", "type", F.round("score", 9).alias("score"), F.round("x0", 9).alias("x0"), F.round("y1", 9).alias("y1"), "error")


def document_markdown(spark: SparkSession, d: str) -> DataFrame:
    return R.markdown(conversation_blocks(spark, d), conversation_pages(spark, d))


def document_json(spark: SparkSession, d: str) -> DataFrame:
    return R.document_json(conversation_blocks(spark, d), 1, conversation_pages(spark, d))


def document_json_v2(spark: SparkSession, d: str) -> DataFrame:
    return R.document_json(conversation_blocks(spark, d), 2, conversation_pages(spark, d))


def page_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Boxes to Markdown: filters, overlaps, routes, recognised text, assembly."""
    t = B.without_overlaps(B.header_footer(B.low_score(layout_boxes(spark, d))))
    t = R.routed(t, _routes(spark)).where("action = 'recognize'")
    t = t.withColumns({"text": F.concat_ws(" ", F.col("type"), F.col("source_index").cast("string")), "error": F.lit(""), "asset": F.lit("")})
    return R.markdown(t)


def chat_payload(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return t.select("conv_id", "turn", C.chat_payload(F.lit("reader"), F.col("text"), F.concat(F.lit("data:image/png;base64,"), T.base64_plain(F.encode("text", "utf-8")))).alias("body"))


def chat_response(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    reason = F.when(F.col("turn") % 3 == 2, "length").otherwise("stop")
    body = F.concat(F.lit('{"choices":[{"finish_reason":"'), reason, F.lit('","message":{"content":'), C.quoted(F.col("text")), F.lit('}}],"usage":{"total_tokens":'), (F.col("turn") + 100).cast("string"), F.lit(',"completion_tokens":'), F.col("turn").cast("string"), F.lit("}}"))
    return t.select("conv_id", "turn", C.chat_answer(body).alias("a")).select("conv_id", "turn", "a.*")


def path_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of output folders of which one is below the other."""
    n = table(spark, d, "nation").select(F.concat(F.lit("/out/"), F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("/"), F.col("n_name"))).otherwise(F.lit(""))).alias("path"), "n_nationkey")
    a, b = n.select(F.col("path").alias("outer"), F.col("n_nationkey").alias("a")), n.select(F.col("path").alias("inner"), F.col("n_nationkey").alias("b"))
    first = lambda c: F.element_at(F.split(c, "/"), 3)
    joined = a.withColumn("k", first("outer")).join(b.withColumn("k", first("inner")), "k")  # two folders that overlap share their first part
    return joined.where((F.col("a") != F.col("b")) & T.under_root(F.col("inner"), F.col("outer"))).select("outer", "inner", "a", "b")


QUERIES = {
    "q_reading_order": reading_order, "q_route_lookup": route_lookup, "q_fallback": fallback, "q_error_policy": error_policy, "q_cross_page_edges": cross_page_edges,
    "q_cross_page_merge": cross_page_merge, "q_simple_table_parse": simple_table_parse, "q_otsl_html": otsl_html, "q_otsl_spans": otsl_spans, "q_csv_strict": csv_strict,
    "q_html_blocks": html_blocks, "q_layout_json": layout_json, "q_mineru_tokens": mineru_tokens, "q_ctc_decode": ctc_decode, "q_tensor_layout": tensor_layout,
    "q_document_markdown": document_markdown, "q_document_json": document_json, "q_document_json_v2": document_json_v2, "q_page_pipeline": page_pipeline,
    "q_chat_payload": chat_payload, "q_chat_response": chat_response, "q_path_overlap": path_overlap,
}

_TRIED = """
tried as (
  select doc_id, doc_id in (select doc_id from labels) as a_ok, doc_id % 7 <> 0 and lang is not null as b_ok, lang, (select any_value(quality) from labels l where l.doc_id = d.doc_id) as quality
  from documents d),
found as (
  select doc_id, case when a_ok then 'a' when b_ok then 'b' end as model, case when a_ok then 'q' || quality when b_ok then lang else '' end as text,
    case when a_ok or b_ok then '' else 'all recognition models failed: a: no response; b: ' || case when doc_id % 7 = 0 then 'HTTP 503' else 'no response' end || '; c: no response' end as error
  from tried)"""
_LINKS = """
links as (
  select *, page = lag(page) over w + 1 and lag(type) over w = 'table' and type = 'table' and lag(y1) over w / 1400 >= 1 - 0.1e0 and y0 / 1400 <= 0.1e0
    and greatest(0e0, least(lag(x1) over w / 1100, x1 / 1100) - greatest(lag(x0) over w / 1100, x0 / 1100)) / greatest(lag(x1) over w / 1100 - lag(x0) over w / 1100, x1 / 1100 - x0 / 1100) >= 0.75e0
    and lag(cols) over w = cols as j
  from tables window w as (partition by doc_id order by page))"""
_ESCAPE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_MARKDOWN = """
  case when reading_order is null then '' when error <> '' then '**[OCR block failed]**' || chr(10) || chr(10) when text = '' then ''
    else case type when 'title' then '# ' || text when 'heading' then '## ' || text else text end || chr(10) || chr(10) end"""
_BLOCK = """
  '{{"id":"p1-{id}","type":' || to_json(type) || ',"raw_type":' || to_json(raw_type) || ',"bbox":[0.0,0.0,0.0,0.0],"score":1.0,"order":' || {order} || ',"rotation":0,"model":"","text":' || to_json(text) || ',"raw_text":"","asset":"","error":' || to_json(error) || '{more}}}'"""
_HEAD = """'{{"schema_version":{version},"source":"conversations/' || doc_id || '","coordinate_system":"page_pixels_xyxy","pages":[{{"page":1,"width":1100,"height":1400,"blocks":['"""
_TAIL = """']}' || case when doc_id % 4 = 0 then ',{"page":2,"width":1100,"height":1400,"blocks":[]}' else '' end || ']}'"""

SQL = {
    "q_reading_order": f"with {CONVERSATION_SQL} select doc_id, source_index, reading_order, row_number() over (partition by doc_id order by reading_order nulls last, source_index) - 1 as position from blocks",
    "q_route_lookup": f"""with {LAYOUT_BOXES_SQL}
select doc_id, source_index, type, case type when 'table' then 'recognize' when 'figure' then 'image' when 'header' then 'skip' when 'chart' then 'image' end as action,
  case when type = 'table' then 't1,t2' when type in ('figure', 'header', 'chart') then '' end as models, type in ('figure', 'chart') as save_crop,
  case when type not in ('table', 'figure', 'header', 'chart') then 'no route for box type ' || type end as route_error from boxes""",
    "q_fallback": f"with {_TRIED} select * from found",
    "q_error_policy": f"""with {_TRIED}
select doc_id // 10 as doc_id, count(*) as blocks, cast(count_if(error <> '') as bigint) as failed_blocks, cast(case when bool_or(error <> '') then 2 else 0 end as int) as record_code,
  case when bool_or(error <> '') then 'failed' else 'succeeded' end as status, cast(case when bool_or(error <> '') then 1 else 0 end as int) as fail_code from found group by 1""",
    "q_cross_page_edges": f"with {PAGE_TABLES_SQL}, {_LINKS} select doc_id, page, coalesce(j, false) as joins from links",
    "q_cross_page_merge": f"""with {PAGE_TABLES_SQL}, {_LINKS},
isle as (select *, sum(case when coalesce(j, false) then 0 else 1 end) over (partition by doc_id order by page) as island from links),
head as (select doc_id, island, min(page) as root, arg_min(rows[1], page) as head, list(page order by page) as pages from isle group by all),
whole as (
  select i.doc_id, i.island, string_agg(list_aggregate(list_transform(case when page > root and len(rows) > 1 and lower(rows[1]) = lower(head) then rows[2:] else rows end, lambda r: r || chr(10)), 'string_agg', ''), '' order by page) as body
  from isle i join head h on i.doc_id = h.doc_id and i.island = h.island group by all)
select i.doc_id, i.page, case when i.page = h.root and len(h.pages) > 1 then list_aggregate(h.pages[2:], 'string_agg', ',') end as merged_pages, case when i.page > h.root then h.root end as merged_into,
  md5(case when i.page > h.root then '' else '<table>' || chr(10) || w.body || '</table>' end) as digest
from isle i join head h on i.doc_id = h.doc_id and i.island = h.island join whole w on i.doc_id = w.doc_id and i.island = w.island""",
    "q_simple_table_parse": f"""with {PAGE_TABLES_SQL}
select doc_id, page, doc_id % 9 <> 0 as is_table, case when doc_id % 9 <> 0 then len(rows) end as rows, case when doc_id % 9 <> 0 then cast(cols as bigint) end as columns from tables""",
    "q_otsl_html": f"""select n_regionkey, '<table>' || chr(10) || string_agg('<tr><td>' || n_nationkey || '</td><td>' || {_ESCAPE.format("n_name || '&'")} || '</td></tr>', chr(10) order by n_nationkey) || chr(10) || '</table>' as html from nation group by n_regionkey""",
    "q_otsl_spans": """select o_orderkey,
  case when o_orderkey % 3 <> 0 then '<table>' || chr(10) || '<tr><td rowspan="2" colspan="2">' || o_orderpriority || '</td></tr>' || chr(10) || '<tr></tr>' || chr(10) || '<tr><td>' || o_orderkey || '</td><td></td></tr>' || chr(10) || '</table>' end as html,
  o_orderkey % 3 = 0 as failed from orders""",
    "q_csv_strict": r"""
with c as (select doc_id, lang, coalesce(text, '') as t from documents),
t as (select doc_id, lang, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as x, doc_id % 10 = 3 or regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]') as failed from c)
select doc_id, case when not failed then md5('<table>' || chr(10) || '<tr><td>id</td><td>lang</td><td>text</td></tr>' || chr(10) || '<tr><td>' || doc_id || '</td><td>' || lang || '</td><td>' ||
  replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '<br>') || '</td></tr>' || chr(10) || '</table>') end as digest, failed from t""",
    "q_html_blocks": r"""
with f as (select page_id as doc_id, regexp_extract_all(coalesce(html, ''), '(?is)<(?:h1|h2|h3|p|footer)>.*?</(?:h1|h2|h3|p|footer)>') as found from pages),
e as (select doc_id, i - 1 as source_index, found[i] as raw from f, unnest(range(1, len(found) + 1)) as t(i))
select doc_id, source_index, case when starts_with(lower(raw), '<h1>') then 'title' when starts_with(lower(raw), '<h2>') or starts_with(lower(raw), '<h3>') then 'heading' when starts_with(lower(raw), '<p>') then 'text' else 'footer' end as type, regexp_replace(raw, '(?s)<[^>]*>', '', 'g') as text from e""",
    "q_layout_json": f"""with {LAYOUT_BOXES_SQL},
k as (select *, row_number() over (partition by doc_id order by source_index) - 1 as n from boxes where score >= 0.5e0)
select doc_id, n as source_index, case type when 'chart' then 'figure' else type end as type, type as raw_type, least(x0, 1100e0) as x0, least(y0, 1400e0) as y0, least(x1, 1100e0) as x1, least(y1, 1400e0) as y1, score,
  cast(case when source_index % 5 = 4 or source_index % 7 = 6 then n else source_index * 2 end as int) as order,
  cast(case when source_index % 5 = 4 then n when source_index % 7 = 6 then null else source_index * 2 end as int) as reading_order, cast(null as varchar) as error from k""",
    "q_mineru_tokens": f"""with {LAYOUT_BOXES_SQL},
t as (select doc_id, source_index, type, cast(x0 as bigint) as a, cast(y0 as bigint) as b from boxes),
m as (select *, max(greatest(a + 100, b + 201)) over (partition by doc_id, source_index) > 1000 as bad from t)
select doc_id, source_index, type as raw_type, a * 2000e0 / 1000 as x0, b * 500e0 / 1000 as y0, (a + 100) * 2000e0 / 1000 as x1, (b + 201) * 500e0 / 1000 as y1,
  cast(case when a % 3 = 0 then 90 else 0 end as int) as rotation, case when bad then 'coordinate over 1000' end as error from m""",
    "q_ctc_decode": """
with s as (select vec_id, t, list_position(x, list_max(x)) - 1 as c from (select vec_id, t, embedding[t * 8 + 1 : t * 8 + 8] as x from embeddings, unnest(range(0, 8)) as r(t)) q),
p as (select *, lag(c) over (partition by vec_id order by t) as before from s)
select vec_id, string_agg(cast(c as varchar), '' order by t) as steps, coalesce(string_agg((['', 'a', 'b', 'c', 'd', 'e', 'f', 'g'])[c + 1], '' order by t) filter (c <> 0 and (before is null or c <> before)), '') as text from p group by vec_id""",
    "q_tensor_layout": """
with p as (select vec_id, list_concat(embedding, [0, 0]) as embedding from embeddings),
r as (select vec_id, i as source_index, [abs(cast(v as double)) for v in embedding[i * 6 + 1 : i * 6 + 6]] as v, cast(floor(abs(embedding[i * 6 + 1]) * 40) as int) as c from p, unnest(range(0, 11)) as t(i)),
b as (select * from r)
select vec_id, source_index, (['text', 'table', 'figure', 'title'])[c + 1] as type, round(v[2], 9) as score, round(v[3] * 10, 9) as x0, round(v[6] * 5, 9) as y1, case when c > 3 then 'class without a label' end as error from b where v[2] >= 0.1e0""",
    "q_document_markdown": f"with {CONVERSATION_SQL} select doc_id, '<!-- page: 1 -->' || chr(10) || chr(10) || string_agg({_MARKDOWN}, '' order by reading_order nulls last, source_index) || case when doc_id % 4 = 0 then '<!-- page: 2 -->' || chr(10) || chr(10) else '' end as markdown from blocks group by doc_id",
    "q_document_json": f"""with {CONVERSATION_SQL}, p as (select *, row_number() over (partition by doc_id order by reading_order nulls last, source_index) - 1 as n from blocks)
select doc_id, {_HEAD.format(version=1)} || string_agg({_BLOCK.format(id="b' || n || '", order="coalesce(reading_order, n)", more="")}, ',' order by n) || {_TAIL} as json from p group by doc_id""",
    "q_document_json_v2": f"""with {CONVERSATION_SQL}, p as (select *, row_number() over (partition by doc_id order by reading_order nulls last, source_index) - 1 as n from blocks)
select doc_id, {_HEAD.format(version=2)} || string_agg({_BLOCK.format(id="s' || source_index || '", order="coalesce(cast(reading_order as varchar), 'null')", more=""","polygon":[],"crop_bbox":[0.0,0.0,0.0,0.0],"reading_order":' || coalesce(cast(reading_order as varchar), 'null') || ',"source_index":' || source_index || ',"provenance":{},"extensions":{}""")}, ',' order by n) || {_TAIL} as json from p group by doc_id""",
    "q_page_pipeline": f"""with recursive {LAYOUT_BOXES_SQL.replace('boxes as', 'every as', 1)}, boxes as (select * from every where score >= 0.3e0 and type <> 'header'),
{PAIRS_SQL},
n as (select doc_id, i, j, case when a_wins then j else i end as loser, row_number() over (partition by doc_id order by i, j) as k from pairs where iou >= 0.5e0),
fold(doc_id, k, gone) as (
  select distinct doc_id, cast(0 as bigint), cast([] as bigint[]) from n
  union all select f.doc_id, n.k, case when list_contains(f.gone, n.i) or list_contains(f.gone, n.j) then f.gone else list_append(f.gone, n.loser) end from fold f join n on n.doc_id = f.doc_id and n.k = f.k + 1),
last as (select doc_id, arg_max(gone, k) as gone from fold group by doc_id),
kept as (select * from boxes left join last using (doc_id) where (gone is null or not list_contains(gone, source_index)) and type not in ('figure', 'chart'))
select doc_id, '<!-- page: 1 -->' || chr(10) || chr(10) || string_agg(case type when 'title' then '# title ' || source_index when 'formula' then '$$' || chr(10) || 'formula ' || source_index || chr(10) || '$$' else type || ' ' || source_index end || chr(10) || chr(10), '' order by source_index) as markdown
from kept group by doc_id""",
    "q_chat_payload": """select conv_id, turn, '{"model":"reader","messages":[{"role":"user","content":[{"type":"image_url","image_url":{"url":"data:image/png;base64,' || base64(encode(coalesce(text, ''))) || '"}},{"type":"text","text":' || to_json(coalesce(text, '')) || '}]}],"temperature":0.0,"max_tokens":4096}' as body from conversations""",
    "q_chat_response": "select conv_id, turn, case when turn % 3 <> 2 then coalesce(text, '') end as text, case when turn % 3 = 2 then 'the answer was cut short' end as error, cast(turn + 100 as bigint) as total_tokens, cast(turn as bigint) as completion_tokens from conversations",
    "q_path_overlap": """
with n as (select '/out/' || n_regionkey || case when n_nationkey % 4 <> 0 then '/' || n_name else '' end as path, n_nationkey from nation)
select x.path as outer, y.path as inner, x.n_nationkey as a, y.n_nationkey as b from n x, n y where x.n_nationkey <> y.n_nationkey and (y.path = x.path or starts_with(y.path, x.path || '/'))""",
}
