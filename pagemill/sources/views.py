"""Tables of pages, boxes, blocks, requests and jobs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 1100, 1400
TYPES = ("text", "table", "chart", "title", "formula", "header", "figure")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each line item: doc_id, page, source_index, type, corners, score, reading order."""
    t = table(spark, sf_dir, "lineitem")
    every = Window.partitionBy("l_orderkey").orderBy(*sorted(t.columns))
    x0, y0 = (F.col("l_partkey") * 37 % 600).cast("double"), (F.col("l_suppkey") * 53 % 800).cast("double")
    kinds = F.array(*map(F.lit, TYPES))
    raw = F.element_at(kinds, F.col("l_linenumber") % len(TYPES) + 1)
    index = (F.row_number().over(every) - 1).cast("bigint")
    return t.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), index.alias("source_index"), raw.alias("type"), raw.alias("raw_type"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 40 + 8 * F.col("l_quantity")).alias("x1"), (y0 + 30 + F.floor("l_extendedprice") % 500).alias("y1"),
        ((20 + 8 * F.round(100 * F.col("l_discount"))) / 100.0).alias("score"), index.cast("int").alias("reading_order"),
    )


#: The same in DuckDB.
LAYOUT_BOXES_SQL = f"""
boxes as (
  select doc_id, source_index, type, x0, y0, x0 + 40 + 8 * l_quantity as x1, y0 + 30 + cast(floor(l_extendedprice) as bigint) % 500 as y1, score
  from (select l_orderkey as doc_id,
      cast(row_number() over (partition by l_orderkey order by l_discount, l_extendedprice, l_linenumber, l_linestatus, l_orderkey, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) - 1 as bigint) as source_index,
      ({list(TYPES)!r})[cast(l_linenumber % {len(TYPES)} + 1 as int)] as type,
      cast(l_partkey * 37 % 600 as double) as x0, cast(l_suppkey * 53 % 800 as double) as y0,
      (20 + 8 * round(100 * l_discount)) / 100.0e0 as score, l_quantity, l_extendedprice
    from lineitem))"""


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the pages of a document."""
    t = table(spark, sf_dir, "orders")
    return t.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("page"), "o_orderkey", "o_totalprice")


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region for each page of doc_pages: an HTML table whose rows are line items, of three columns or two."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    three = F.col("l_orderkey") % 8 == 0
    row = F.concat(F.lit("<tr>"), cell("l_linenumber"), cell("q"), F.when(three, cell("l_partkey")).otherwise(F.lit("")), F.lit("</tr>"))
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", row.alias("row")))).alias("rows"))
    html = F.concat(F.lit("<table>\n"), F.array_join(F.transform("rows", lambda r: F.concat(r["row"], F.lit("\n"))), ""), F.lit("</table>"))
    pages = doc_pages(spark, sf_dir)
    key = F.col("o_orderkey")
    return pages.join(rows, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "doc_id", "page", F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), F.lit(0).cast("bigint").alias("source_index"),
        F.when(key % 16 == 15, "text").otherwise("table").alias("type"), F.lit(0).alias("reading_order"),
        (key % 3 * 20).cast("double").alias("x0"), F.when(key % 5 == 4, 400.0).otherwise(20.0).alias("y0"),
        (F.lit(1000) + key % 2 * 50).cast("double").alias("x1"), F.when(key % 7 == 6, 900.0).otherwise(1390.0).alias("y1"),
        html.alias("text"), F.lit("").alias("error"), F.lit("").alias("asset"),
    )


PAGE_TABLES_SQL = """
pages as (select o_custkey as doc_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as page, o_orderkey as k from orders),
tr as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) as q,
    '<tr><td>' || l_linenumber || '</td><td>' || cast(l_quantity as bigint) || '</td>' || case when l_orderkey % 8 = 0 then '<td>' || l_partkey || '</td>' else '' end || '</tr>' as r
  from lineitem),
html as (select l_orderkey as k, list(r order by l_linenumber, l_partkey, l_suppkey, q, r) as rows from tr group by l_orderkey),
tables as (
  select doc_id, page, case when k % 16 = 15 then 'text' else 'table' end as type, cast(k % 3 * 20 as double) as x0, case when k % 5 = 4 then 400e0 else 20e0 end as y0,
    cast(1000 + k % 2 * 50 as double) as x1, case when k % 7 = 6 then 900e0 else 1390e0 end as y1, rows, case when k % 8 = 0 then 3 else 2 end as cols
  from pages join html using (k))"""


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as regions of one page each; system turns have no reading order, some turns carry an error."""
    t = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "heading").when(F.col("role") == "system", "title").otherwise("text")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t.select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), (F.row_number().over(w) - 1).cast("bigint").alias("source_index"),
        kind.alias("type"), F.col("role").alias("raw_type"), F.when(F.col("turn") % 7 != 6, F.col("turn")).cast("int").alias("reading_order"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "model failed").otherwise("").alias("error"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("asset"),
    )


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of conversations: the turns are on the first; every fourth has a second without any."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    numbers = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.select("doc_id", F.explode(numbers).alias("page"), F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), F.concat(F.lit("conversations/"), F.col("doc_id").cast("string")).alias("source"))


CONVERSATION_SQL = """
blocks as (
  select conv_id as doc_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as source_index,
    case role when 'user' then 'heading' when 'system' then 'title' else 'text' end as type, role as raw_type,
    case when turn % 7 <> 6 then cast(turn as int) end as reading_order, case when (conv_id + turn) % 11 = 0 then 'model failed' else '' end as error,
    coalesce(text, '') as text
  from conversations)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model requests: ticket, model, visual and prefill cost."""
    t = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0).cast("bigint"))
    return t.select(F.col("event_id").alias("ticket"), F.col("event_type").alias("model"), F.col("user_id"), (k + 1).alias("visual"), (k + 65).alias("prefill"))


REQUESTS_SQL = """
requests as (
  select event_id as ticket, event_type as model, user_id, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) + 1 as visual,
    coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) + 65 as prefill
  from events)"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished model requests; errors carry a kind, by user."""
    t = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    kind = F.element_at(F.array(*map(F.lit, ("cancelled", "http_429", "http_503", "http_timeout", "model_error"))), (F.col("user_id") % 5 + 1).cast("int"))
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0).cast("bigint"))
    return t.select(
        F.col("event_id").alias("ticket"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), "ts", failed.alias("failed"),
        F.when(failed, kind).alias("kind"), F.coalesce("value", F.lit(0.0)).alias("latency_ms"), (k * 3).alias("total_tokens"), (k + F.col("user_id") % 4 * 40).alias("output_tokens"),
        (F.col("user_id") % 7).cast("double").alias("queue_ms"), (k + 100).alias("work"),
    )


COMPLETIONS_SQL = """
done as (
  select event_id as ticket, 'm' || (user_id % 3) as model, ts, event_type = 'error' as failed,
    case when event_type = 'error' then (['cancelled', 'http_429', 'http_503', 'http_timeout', 'model_error'])[cast(user_id % 5 + 1 as int)] end as kind,
    coalesce(value, 0e0) as latency_ms, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) * 3 as total_tokens,
    coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) + user_id % 4 * 40 as output_tokens,
    cast(user_id % 7 as double) as queue_ms, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) + 100 as work
  from events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: priority from the order's, state from its status."""
    t = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return t.select(F.col("o_orderkey").alias("sequence"), (5 - F.coalesce(F.substring("o_orderpriority", 1, 1).try_cast("int"), F.lit(5))).alias("priority"), state.alias("state"), F.floor(F.col("o_totalprice")).cast("bigint").alias("upload_bytes"), F.col("o_orderdate").alias("created"))


JOBS_SQL = """
jobs as (
  select o_orderkey as sequence, 5 - coalesce(try_cast(substr(o_orderpriority, 1, 1) as int), 5) as priority,
    case o_orderstatus when 'F' then 'succeeded' when 'O' then 'queued' else 'failed' end as state, cast(floor(o_totalprice) as bigint) as upload_bytes, o_orderdate as created
  from orders)"""
