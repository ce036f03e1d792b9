"""Routing of boxes to models, ordered fallback, error policy, tables across pages, and assembly of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.geometry import x_overlap
from pagemill.functions.text import columns_of, compact, table_close, table_open, table_rows

PAGE = ["doc_id", "page"]
ROUTES = "type string, action string, models array<string>"


def routed(boxes: DataFrame, routes: DataFrame) -> DataFrame:
    """boxes with action, models, save_crop and route_error: the route of the type, else of `*`. routes: one row a type."""
    exact = F.broadcast(routes.select(F.col("type").alias("_t"), F.struct("action", "models").alias("exact")))  # a configuration's routes
    other = F.broadcast(routes.where("type = '*'").select(F.struct("action", "models").alias("other")).limit(1))
    t = boxes.join(exact, F.col("type") == F.col("_t"), "left").join(other, F.lit(True), "left")
    route = F.coalesce("exact", "other")
    return t.withColumns({
        "action": F.when(route["action"] == "save_crop", F.lit("image")).otherwise(route["action"]), "models": route["models"],
        "save_crop": F.coalesce(route["action"].isin("image", "save_crop"), F.lit(False)),
        "route_error": F.when(route.isNull(), F.concat(F.lit("no route for box type "), F.col("type"))),
    }).drop("_t", "exact", "other")


def first_success(regions: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """regions (keys, models) with model, text and error of the first of its models that answered.

    responses: keys, model, response, error; a missing response is an error. If all fail, error lists why, in order.
    """
    tried = regions.select(*keys, F.posexplode("models").alias("rank", "model")).join(responses, [*keys, "model"], "left")
    problem = F.coalesce("error", F.when(F.col("response").isNull(), F.lit("no response")))
    tried = tried.withColumn("problem", problem)
    one = F.min(F.when(F.col("problem").isNull(), F.struct("rank", "model", "response"))).alias("best")
    why = F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("rank", F.concat_ws(": ", "model", "problem").alias("what"))))).alias("why")
    best = tried.groupBy(*keys).agg(one, why)
    joined = F.concat(F.lit("all recognition models failed: "), F.array_join(F.transform("why", lambda w: w["what"]), "; "))
    found = best.select(*keys, F.col("best.model").alias("model"), F.coalesce("best.response", F.lit("")).alias("text"), F.when(F.col("best").isNull(), joined).otherwise("").alias("error"))
    return regions.join(found, keys, "left")


def fatal(columns: list[str], on_error: str) -> Column:
    """(later, page, source_index, error) of a block that fails its document: a layout error always, others where on_error is fail."""
    layout = F.col("layout_error") if "layout_error" in columns else F.lit(None).cast("string")
    return F.when(F.col("error") != "" if on_error == "fail" else layout.isNotNull(), F.struct(layout.isNull().alias("later"), "page", "source_index", "error"))


def document_status(regions: DataFrame, on_error: str = "record") -> DataFrame:
    """For each doc_id: blocks, failed blocks, status and exit_code. on_error fail makes a failed block the document's failure; a layout_error always is."""
    out = regions.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("error") != "").alias("failed_blocks"), F.min(fatal(regions.columns, on_error)).alias("first"))
    bad = F.col("first").isNotNull()
    code = F.when(bad, 1).when(F.col("failed_blocks") > 0, 2).otherwise(0)
    return out.select("doc_id", "blocks", "failed_blocks", F.when(bad, "failed").otherwise("succeeded").alias("status"), code.alias("exit_code"), F.col("first.error").alias("document_error"))


def batch_exit_code(status: DataFrame) -> DataFrame:
    """One row: 1 if a document failed, else 2 if a block did, else 0."""
    return status.agg(F.when(F.max(F.col("exit_code") == 1), 1).when(F.max(F.col("exit_code") == 2), 2).otherwise(0).alias("exit_code"))


def edges(regions: DataFrame) -> DataFrame:
    """For each page its first and last region in reading order that shows something, with the page's size."""
    shown = regions.where("reading_order is not null and (text <> '' or asset <> '')")
    place = F.struct("reading_order", "source_index")
    what = F.struct("source_index", "type", "x0", "y0", "x1", "y1", "text", "error", "asset")
    return shown.groupBy(*PAGE, "width", "height").agg(F.min_by(what, place).alias("first"), F.max_by(what, place).alias("last"))


def with_shape(df: DataFrame, region: str, name: str) -> DataFrame:
    """df with the shape of a region that is a table: cells of a row (null unless all rows have as many and none spans), rows, and the first row without white space and case.

    Steps are columns, so that no expression is computed anew for each row of a table.
    """
    df = df.withColumn("_rows", F.when(F.col(region)["type"] == "table", table_rows(F.col(region)["text"])))
    df = df.withColumn("_parts", F.transform("_rows", lambda r: F.struct(columns_of(r).alias("cells"), compact(r).alias("text")))).withColumn("_first", F.get("_parts", F.lit(0)))
    even = F.forall("_parts", lambda p: (p["cells"] == F.col("_first")["cells"]) & (p["cells"] > 0) & ~p["text"].rlike("colspan|rowspan"))
    return df.withColumn(name, F.struct(F.when(even, F.col("_first")["cells"]).alias("cells"), F.size("_parts").alias("rows"), F.col("_first")["text"].alias("head"))).drop("_rows", "_parts", "_first")


def mergeable(a: Column, b: Column, shape_a: Column, shape_b: Column, size_a: tuple[Column, Column], size_b: tuple[Column, Column], margin: float = 0.1, alignment: float = 0.75, header: bool = False) -> Column:
    """Whether table b at the top of a page continues table a at the end of the page before."""
    tables = (a["type"] == "table") & (b["type"] == "table") & (a["error"] == "") & (b["error"] == "") & (a["asset"] == "") & (b["asset"] == "")
    sized = (size_a[0] > 0) & (size_a[1] > 0) & (size_b[0] > 0) & (size_b[1] > 0)
    placed = (a["y1"] / size_a[1] >= 1 - margin) & (b["y0"] / size_b[1] <= margin)
    aligned = x_overlap(a["x0"] / size_a[0], a["x1"] / size_a[0], b["x0"] / size_b[0], b["x1"] / size_b[0]) >= alignment
    repeated = (shape_b["rows"] > 1) & (shape_a["head"] == shape_b["head"])
    return F.coalesce(sized & tables & placed & aligned & (shape_a["cells"] == shape_b["cells"]) & (repeated if header else F.lit(True)), F.lit(False))


def page_links(regions: DataFrame, **options) -> DataFrame:
    """For each page with an edge: whether its first region continues the last of the page before."""
    e = with_shape(edges(regions), "first", "first_shape")
    alone = F.col("first.source_index") == F.col("last.source_index")  # its shape is known
    e = with_shape(e.withColumn("other", F.when(~alone, F.col("last"))), "other", "last_shape").withColumn("last_shape", F.when(alone, F.col("first_shape")).otherwise(F.col("last_shape"))).drop("other")
    w = Window.partitionBy("doc_id").orderBy("page")
    before = lambda c: F.lag(c).over(w)
    near = e.withColumns({"p_last": before("last"), "p_shape": before("last_shape"), "p_page": before("page"), "p_width": before("width"), "p_height": before("height")})
    joins = (F.col("p_page") == F.col("page") - 1) & mergeable(F.col("p_last"), F.col("first"), F.col("p_shape"), F.col("first_shape"), (F.col("p_width"), F.col("p_height")), (F.col("width"), F.col("height")), **options)
    return near.withColumn("joins", F.coalesce(joins, F.lit(False)))


def stitched(regions: DataFrame, **options) -> DataFrame:
    """regions after tables that go on across pages are joined into their first page's: with merged_pages, merged_into.

    Links of neighbours make islands; a chain goes on through a page only if its joined table is the page's last region too.
    Only the first page's first row decides whether a header is repeated.
    """
    links = page_links(regions, **options)
    w = Window.partitionBy("doc_id").orderBy("page")
    through = F.col("first.source_index") == F.col("last.source_index")
    starts = ~F.col("joins") | ~F.coalesce(F.lag(through).over(w), F.lit(False)) | ~F.coalesce(F.lag("joins").over(w), F.lit(False))
    chain = links.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("joins")
    parts = chain.groupBy("doc_id", "island").agg(
        F.min_by(F.struct(F.col("p_page").alias("page"), F.col("p_last.source_index").alias("source_index"), F.col("p_last.text").alias("text")), "page").alias("root"),
        F.array_sort(F.collect_list(F.struct("page", F.col("first.source_index").alias("source_index"), F.col("first.text").alias("text")))).alias("more"),
    )
    parts = parts.withColumns({"own": table_rows(F.col("root.text")), "others": F.transform("more", lambda m: table_rows(m["text"]))})
    parts = parts.withColumn("head", compact(F.get("own", F.lit(0))))
    cut = lambda rows: F.when((F.size(rows) > 1) & (compact(F.get(rows, F.lit(0))) == F.col("head")), F.slice(rows, 2, 1 << 20)).otherwise(rows)
    rows = F.concat("own", F.flatten(F.transform("others", cut)))
    text = F.concat(table_open(F.col("root.text")), F.lit("\n"), F.array_join(F.transform(rows, lambda r: F.concat(r, F.lit("\n"))), ""), table_close(F.col("root.text")))
    parts = parts.withColumn("joined", text)
    roots = parts.select("doc_id", "root.page", "root.source_index", "joined", F.transform("more", lambda m: m["page"]).alias("merged_pages"), F.lit(None).cast("struct<page:int,source_index:bigint>").alias("merged_into"))
    rest = parts.select("doc_id", F.struct("root.page", "root.source_index").alias("merged_into"), F.explode("more").alias("m"))
    rest = rest.select("doc_id", "m.page", "m.source_index", F.lit("").alias("joined"), F.lit(None).cast("array<int>").alias("merged_pages"), "merged_into")
    out = regions.join(roots.unionByName(rest), [*PAGE, "source_index"], "left")
    return out.withColumn("text", F.coalesce("joined", "text")).drop("joined")


def by_order(regions: DataFrame, value: Column) -> Column:
    """Aggregate of a page's values in reading order, those without one last."""
    key = F.struct(F.col("reading_order").isNull().alias("n"), F.col("reading_order").alias("o"), F.col("source_index").alias("i"), value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(key)), lambda k: k["v"])


def in_order(structs: Column, key: str) -> Column:
    """An array of structs by one distinct field; the others need not be orderable."""
    return F.array_sort(structs, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))


def block_markdown() -> Column:
    text = F.col("text")
    formula = F.when(text.startswith("$$") | text.startswith("\\["), text).otherwise(F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
    shown = F.when(F.col("type") == "title", F.concat(F.lit("# "), text)).when(F.col("type") == "heading", F.concat(F.lit("## "), text)).when(F.col("type").isin("formula", "equation"), formula).otherwise(text)
    image = F.when(F.col("asset") != "", F.concat(F.lit("![document region]("), F.col("asset"), F.lit(")\n\n"))).otherwise("")
    body = F.concat(image, F.when(text != "", F.concat(shown, F.lit("\n\n"))).otherwise(""))
    return F.when(F.col("reading_order").isNull(), "").when(F.col("error") != "", "**[OCR block failed]**\n\n").otherwise(body)


def markdown(regions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id and markdown: pages by number, blocks in reading order. One shuffle: pages and documents share a key prefix.

    With pages (doc_id, page) those without a region are there, too.
    """
    bodies = regions.groupBy(*PAGE).agg(F.array_join(by_order(regions, block_markdown()), "").alias("body"))
    if pages is not None:
        bodies = pages.select(*PAGE).distinct().join(bodies, PAGE, "left").withColumn("body", F.coalesce("body", F.lit("")))
    part = F.concat(F.lit("<!-- page: "), F.col("page").cast("string"), F.lit(" -->\n\n"), F.col("body"))
    whole = bodies.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", part.alias("part")))).alias("parts"))
    return whole.select("doc_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("markdown"))


def block_struct(columns: list[str], version: int) -> Column:
    """The fields of one block of the JSON output, absent columns with their defaults."""

    def have(name: str, default) -> Column:
        return (F.coalesce(F.col(name), F.lit(default)) if default is not None else F.col(name)) if name in columns else F.lit(default)

    ident = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-b"), F.col("position").cast("string")) if version == 1 else F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-s"), F.col("source_index").cast("string"))
    box = F.array(*(have(s, 0.0).cast("double") for s in ("x0", "y0", "x1", "y1")))
    fields = [
        ident.alias("id"), F.col("type"), have("raw_type", "").alias("raw_type"), box.alias("bbox"), have("score", 1.0).alias("score"),
        (F.col("reading_order") if version == 2 else F.coalesce(have("order", None).cast("int"), F.col("reading_order"), F.col("position").cast("int"))).alias("order"),
        have("rotation", 0).cast("int").alias("rotation"), have("model", "").alias("model"), F.col("text"), have("raw_text", "").alias("raw_text"), have("asset", "").alias("asset"), have("error", "").alias("error"),
    ]
    if version == 2:
        polygon = F.col("polygon") if "polygon" in columns else F.array().cast("array<struct<x:double,y:double>>")
        crop = F.coalesce(F.array(*(F.col(f"crop_bbox.{s}") for s in ("x0", "y0", "x1", "y1"))), box) if "crop_bbox" in columns else box
        extensions = [F.col(c) for c in ("parent_source_index", "composite_children", "merged_pages", "merged_into", "recovered") if c in columns]
        provenance = [F.col(c) for c in ("adapter", "layout_pass") if c in columns]
        told = F.parse_json(F.to_json(F.struct(*provenance)) if provenance else F.lit("{}")).alias("provenance")
        fields += [F.transform(polygon, lambda p: F.array(p["x"], p["y"])).alias("polygon"), crop.alias("crop_bbox"), F.col("reading_order"), F.col("source_index"), told, F.parse_json(F.to_json(F.struct(*extensions)) if extensions else F.lit("{}")).alias("extensions")]
    return F.struct(*fields)


def second_schema(columns: list[str]) -> Column:
    """Whether a block has what only the second schema can say."""
    tests = [F.col("reading_order").isNull()] + [F.col(c).isNotNull() for c in ("polygon", "parent_source_index", "composite_children", "merged_pages", "merged_into", "adapter", "layout_pass") if c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def document_json(regions: DataFrame, version: int, pages: DataFrame | None = None) -> DataFrame:
    """doc_id and json: schema_version, source, coordinate_system, and pages with size and blocks; nulls are written out.

    pages (doc_id, page, width, height, source) are all pages of the documents; without it those of the regions, which may have
    the same columns.
    """
    w = Window.partitionBy(*PAGE).orderBy(F.col("reading_order").asc_nulls_last(), "source_index")
    placed = regions.withColumn("position", F.row_number().over(w) - 1).withColumn("block", block_struct(regions.columns, version))
    known = {"width": "int", "height": "int", "source": "string"}
    if pages is None:
        placed = placed.withColumns({c: F.lit(None).cast(t) for c, t in known.items() if c not in placed.columns})
        sizes = [F.max(c).alias(c) for c in known]
    else:
        sizes = []
    found = placed.groupBy(*PAGE).agg(in_order(F.collect_list(F.struct("position", "block")), "position").alias("blocks"), *sizes)
    if pages is not None:
        found = pages.withColumns({c: F.lit(None).cast(t) for c, t in known.items() if c not in pages.columns}).select(*PAGE, *known).dropDuplicates(PAGE).join(found, PAGE, "left")
    blocks = F.coalesce(F.transform("blocks", lambda b: b["block"]), F.expr("array()")).alias("blocks")
    whole = found.groupBy("doc_id").agg(in_order(F.collect_list(F.struct("page", "width", "height", blocks)), "page").alias("pages"), F.coalesce(F.max("source"), F.lit("")).alias("source"))
    out = F.struct(F.lit(version).alias("schema_version"), "source", F.lit("page_pixels_xyxy").alias("coordinate_system"), "pages")
    return whole.select("doc_id", F.to_json(out, {"ignoreNullFields": "false"}).alias("json"))


def documents(regions: DataFrame, pages: DataFrame, on_error: str = "record") -> DataFrame:
    """doc_id, json, markdown, status, exit_code and document_error of all documents of pages, from one pass over their regions.

    pages: doc_id, page, width, height and maybe source. A document is of the second schema if one of its blocks needs it.
    """
    w = Window.partitionBy(*PAGE).orderBy(F.col("reading_order").asc_nulls_last(), "source_index")
    t = regions.withColumn("position", F.row_number().over(w) - 1)
    t = t.select(*PAGE, "position", "source_index", "error", block_struct(regions.columns, 1).alias("one"), block_struct(regions.columns, 2).alias("two"), block_markdown().alias("shown"), second_schema(regions.columns).alias("second"), fatal(regions.columns, on_error).alias("fatal"))
    found = t.groupBy(*PAGE).agg(
        in_order(F.collect_list(F.struct("position", "one", "two", "shown")), "position").alias("blocks"), F.max("second").alias("second"),
        F.count_if(F.col("error") != "").alias("failed"), F.min("fatal").alias("fatal"),
    )
    source = F.col("source") if "source" in pages.columns else F.lit(None).cast("string")
    found = pages.select(*PAGE, "width", "height", source.alias("source")).dropDuplicates(PAGE).join(found, PAGE, "left")
    listed = lambda name: F.coalesce(F.transform("blocks", lambda b: b[name]), F.expr("array()"))
    shown = F.concat(F.lit("<!-- page: "), F.col("page").cast("string"), F.lit(" -->\n\n"), F.array_join(listed("shown"), ""))
    whole = found.groupBy("doc_id").agg(
        in_order(F.collect_list(F.struct("page", "width", "height", listed("one").alias("one"), listed("two").alias("two"), shown.alias("shown"))), "page").alias("all"),
        F.coalesce(F.max("source"), F.lit("")).alias("source"), F.coalesce(F.max("second"), F.lit(False)).alias("second"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.min("fatal").alias("fatal"),
    )

    def envelope(version: int, name: str) -> Column:
        all_pages = F.transform("all", lambda p: F.struct(p["page"].alias("page"), p["width"].alias("width"), p["height"].alias("height"), p[name].alias("blocks")))
        return F.to_json(F.struct(F.lit(version).alias("schema_version"), "source", F.lit("page_pixels_xyxy").alias("coordinate_system"), all_pages.alias("pages")), {"ignoreNullFields": "false"})

    bad = F.col("fatal").isNotNull()
    return whole.select(
        "doc_id", F.when(F.col("second"), envelope(2, "two")).otherwise(envelope(1, "one")).alias("json"), F.array_join(F.transform("all", lambda p: p["shown"]), "").alias("markdown"),
        F.when(bad, "failed").otherwise("succeeded").alias("status"), F.when(bad, 1).when(F.col("failed") > 0, 2).otherwise(0).alias("exit_code"), F.col("fatal.error").alias("document_error"),
    )
