"""The whole pipeline as one plan: detector answers and page images to JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.geometry import SIDES
from pagemill.operators import boxes as B
from pagemill.operators import layout as L
from pagemill.operators import models as M
from pagemill.operators import regions as R
from pagemill.operators.crops import cropped, encoded
from pagemill.plans.config import validated

KEYS = ["doc_id", "page", "source_index"]


class Pipeline:
    """Plans a configuration's steps over tables. Nothing runs until a result is written or counted."""

    def __init__(self, config: dict):
        self.config = validated(config)

    def on(self, step: str) -> dict | None:
        s = self.config["postprocess"].get(step)
        return s if s and s.get("enabled") else None

    def parsed(self, answers: DataFrame) -> DataFrame:
        """Boxes of answers by the layout's adapter, all with the same columns."""
        layout = self.config["layout"]
        provider, threshold, names = layout.get("provider", "paddle"), layout["score_threshold"], layout.get("type_map") or {}
        if provider in L.ADAPTERS:
            return L.from_json_boxes(answers, provider, threshold, names)
        if provider == "mineru":
            t = L.from_tokens(answers).withColumns({"score": F.lit(1.0), "order": F.col("source_index").cast("int"), "reading_order": F.col("source_index").cast("int")})
        elif provider == "paddle.doclayout_v3.http":
            t = L.from_polygon_boxes(answers, tuple(layout.get("transform", (1, 0, 0, 0, 1, 0, 0, 0, 1))), threshold).withColumns({"rotation": F.lit(0), "adapter": F.lit(provider)})
        else:
            raise ValueError(f"unknown layout provider {provider!r}")
        return B.with_type(t, names)

    def checked(self, answers: DataFrame) -> DataFrame:
        """All boxes of detector answers (doc_id, page, width, height, response) with layout_error; invalid ones count on behind the page's others."""
        t = B.page_error(self.parsed(answers), self.config["layout"]["max_boxes"]).withColumn("layout_error", F.coalesce("page_error", "error"))
        page, invalid = Window.partitionBy(*B.PAGE), Window.partitionBy(*B.PAGE, F.col("error").isNull()).orderBy("order", "raw_type", *SIDES, "score", "rotation")
        return t.withColumn("source_index", F.coalesce("source_index", F.count("source_index").over(page) + F.row_number().over(invalid) - 1)).drop("page_error", "error")

    def failed(self, answers: DataFrame) -> DataFrame:
        """Regions of the boxes that boxes() leaves out, each with its layout error."""
        t = self.checked(answers).where("layout_error is not null")
        return t.withColumns({"text": F.lit(""), "error": F.col("layout_error"), "asset": F.lit("")})

    def detected(self, pages: DataFrame, masks: DataFrame | None = None) -> DataFrame:
        """Answers of the layout model on page images (doc_id, page, width, height, rgb); with masks only masked pages, those areas white."""
        layout = self.config["layout"]
        prompt = layout.get("prompt", "\nLayout Detection:" if layout.get("provider") == "mineru" else "")
        asked = encoded(pages, masks).withColumns({"type": F.lit("layout"), "prompt": F.lit(prompt)})
        model = self.config["models"][layout["model"]]
        found = M.recognise(asked, model | {"id": layout["model"], "adapter": "text"}, B.PAGE, "image", model["batch_size"], tuple(self.config.get("plugins", ())))
        return asked.select(*B.PAGE, "width", "height").join(found.select(*B.PAGE, F.coalesce("response", F.lit("")).alias("response")), B.PAGE)

    def boxes(self, answers: DataFrame, images: DataFrame | None = None) -> DataFrame:
        """Boxes of detector answers without a layout error, filtered and in reading order.

        With images, pages with composites are shown to the layout model again, those areas white; what is new there is added.
        """
        t = self.checked(answers).where("layout_error is null").drop("layout_error")
        if s := self.on("low_score"):
            t = B.low_score(t, s["threshold"])
        if s := self.on("header_footer"):
            t = B.header_footer(t, tuple(s.get("types", B.HEADER_FOOTER)))
        if s := self.on("composite"):
            found = self.recovered(t, images, s) if images is not None else None
            t = B.composites(t, tuple(s.get("outer_types", B.OUTER)), tuple(s.get("expand_inner_types", B.EXPAND)), s["containment_threshold"], s["retain_min_score"], s.get("inspect_inner_text", False))
            t = t.unionByName(found, allowMissingColumns=True) if found is not None else t
        if s := self.on("overlap"):
            related = None
            if "provisional_children" in t.columns:
                related = lambda a, b: F.array_contains(a["provisional_children"], b["source_index"]) | F.array_contains(b["provisional_children"], a["source_index"])
            t = B.without_overlaps(t, threshold=s["iou_threshold"], margin=s["score_margin"], labels=tuple(s.get("label_priority", B.LABEL_PRIORITY)), related=related)
        return B.ordered(t)

    def recovered(self, boxes: DataFrame, images: DataFrame, settings: dict) -> DataFrame:
        """Boxes that only the second layout pass shows, numbered on."""
        masked = B.masks(B.forest(boxes, settings["containment_threshold"]), tuple(settings.get("outer_types", B.OUTER)))
        again = self.checked(self.detected(images, masked)).where("layout_error is null").drop("layout_error")
        low, ignored = self.on("low_score"), self.on("header_footer")
        threshold = low["threshold"] if low else 0.0
        types = tuple(ignored.get("types", B.HEADER_FOOTER)) if ignored else ()
        out = B.recovered(boxes, again, masked, threshold, types, most=settings["max_recovered_boxes"])
        return out.where("recovered").withColumn("layout_pass", F.lit(2))

    def routes(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, r["action"], r.get("models", [])) for k, r in self.config["routes"].items()], R.ROUTES)

    def by_route(self, key: str, default) -> Column:
        """A setting of each region's route."""
        routes = self.config["routes"]
        other = routes.get("*", {}).get(key, default)
        return F.coalesce(F.create_map(*(F.lit(x) for k, r in routes.items() for x in (k, r.get(key, default))))[F.col("type")], F.lit(other))

    def with_crops(self, regions: DataFrame, images: DataFrame) -> DataFrame:
        """regions with crop (PNG) and crop_error of those that a route shows or reads."""
        t = regions.withColumns({"cropper": self.by_route("cropper", "bbox"), "fallback": self.by_route("crop_fallback", "").isin("bbox", "bbox_crop")})
        t = t if "polygon" in t.columns else t.withColumn("polygon", F.lit(None).cast("array<struct<x:double,y:double>>"))
        found = cropped(t.where("action in ('recognize', 'image')"), images)
        return regions.join(found, KEYS, "left")

    def recognised(self, boxes: DataFrame, prompts: dict[str, str] | None = None, images: DataFrame | None = None) -> DataFrame:
        """Regions with text: each model is asked for its candidates only, the first that answers counts.

        With images models see each region's crop, and regions whose route saves it name it in asset; a region that can't be
        cropped has an error.
        """
        routes = self.config["routes"]
        prompt = F.coalesce(F.create_map(*(F.lit(x) for k, r in routes.items() for x in (k, (prompts or {}).get(k, r.get("prompt", "")))))[F.col("type")], F.lit(routes.get("*", {}).get("prompt", "")))
        t = R.routed(boxes, self.routes(boxes.sparkSession)).withColumn("prompt", prompt)
        t = self.with_crops(t, images) if images is not None else t.withColumns({"crop": F.lit(None).cast("binary"), "crop_error": F.lit(None).cast("string")})
        asked = t.where("action = 'recognize' and crop_error is null")
        answers = None
        for name in dict.fromkeys(m for r in routes.values() if r["action"] == "recognize" for m in r.get("models", [])):
            adapters = {k: r.get("adapter") for k, r in routes.items() if name in r.get("models", [])}
            settings = self.config["models"][name] | {"id": name, "adapter": next(iter(adapters.values())) if len(set(adapters.values())) == 1 else None}
            some = M.recognise(asked.where(F.array_contains("models", name)), settings, KEYS, "crop" if images is not None else None, self.config["models"][name]["batch_size"], tuple(self.config.get("plugins", ())))
            answers = some if answers is None else answers.unionByName(some)
        if answers is None:  # no route reads
            answers = asked.limit(0).select(*KEYS, F.lit("").alias("model"), *(F.lit(None).cast("string").alias(c) for c in ("response", "raw_text", "error", "kind")))
        found = R.first_success(asked, answers, KEYS)
        rest = t.where("action is null or action <> 'recognize' or crop_error is not null").withColumns({"model": F.lit(None).cast("string"), "text": F.lit(""), "error": F.coalesce("route_error", "crop_error", F.lit(""))})
        saved = (F.col("save_crop") | self.by_route("save_crop", False)) & F.col("crop").isNotNull()
        asset = F.when(saved, F.concat(F.lit("assets/page-"), F.col("page").cast("string"), F.lit("-box-"), F.col("position").cast("string"), F.lit(".png"))).otherwise("")
        out = found.unionByName(rest).withColumn("asset", asset).withColumn("model", self.bound_name())
        s = self.on("composite")
        if s and s.get("inspect_inner_text"):
            out = B.finalised(out.drop("parent_source_index"), s.get("expand_if_uncovered_text", True), s["min_inner_text_chars"])
        return out

    def bound_name(self) -> Column:
        """The name a region's route gives its model, else the model's own."""
        routes, model = self.config["routes"], F.col("model")
        name, listed = F.lit(None).cast("string"), F.col("type").isin(*routes)
        for kind, r in routes.items():
            if ids := r.get("binding_ids"):
                here = F.col("type") == kind if kind != "*" else ~listed
                name = F.when(here, F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))[model]).otherwise(name)
        return F.coalesce(name, model)

    def regions(self, answers: DataFrame, images: DataFrame | None = None) -> DataFrame:
        """All regions of detector answers: recognised, stitched, and those that failed in the layout."""
        regions = self.recognised(self.boxes(answers, images), images=images)
        if s := self.on("cross_page_tables"):
            sizes = answers.select("doc_id", "page", "width", "height").distinct()
            regions = R.stitched(regions.join(sizes, ["doc_id", "page"]), margin=s["edge_margin_ratio"], alignment=s["x_overlap_threshold"], header=s.get("require_header_match", False)).drop("width", "height")
        return regions.unionByName(self.failed(answers), allowMissingColumns=True)

    def documents(self, answers: DataFrame, images: DataFrame | None = None) -> DataFrame:
        """doc_id, json, markdown, status, exit_code and document_error of detector answers (doc_id, page, width, height, response[, source]).

        Every page of answers is in its document, with regions or without. images: pixels of the pages, see recognised().
        """
        return R.documents(self.regions(answers, images).drop("crop"), answers, self.config["execution"]["on_error"])

    def assets(self, answers: DataFrame, images: DataFrame) -> DataFrame:
        """doc_id, asset and crop (PNG) of the regions whose crop is saved, for sinks.write_assets."""
        return self.recognised(self.boxes(answers, images), images=images).where("asset <> ''").select("doc_id", "asset", "crop")
