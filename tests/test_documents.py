"""Layout adapters, codecs, routing, stitching, assembly, sinks and the whole pipeline."""

import http.server
import io
import json
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import images as images_module
from pagemill.functions import text as T
from pagemill.operators import codecs as C
from pagemill.operators import layout as L
from pagemill.operators import models as M
from pagemill.operators import regions as R
from pagemill.operators import sinks
from pagemill.plans import doc_queries
from pagemill.plans.config import ConfigError, normalised, validated
from pagemill.plans.pipeline import Pipeline
from pagemill.sources import files

ANSWER = "doc_id bigint, page int, width int, height int, response string"


def answers(spark, response, width=100, height=100):
    return spark.createDataFrame([(1, 1, width, height, response if isinstance(response, str) else json.dumps(response))], ANSWER)


def test_normalised_and_wrapped_layouts(spark):
    t = L.from_json_boxes(answers(spark, {"boxes": [{"type": "b", "bbox": [0.5, 0, 1, 1], "order": 1}, {"type": "a", "bbox": [0, 0, 0.5, 0.5], "order": 0}]}, 200), "normalized").orderBy("reading_order").collect()
    assert [(r.type, r.x0, r.x1) for r in t] == [("a", 0, 100), ("b", 100, 200)]
    (r,) = L.from_json_boxes(answers(spark, {"res": {"boxes": [{"label": "t", "coordinate": [-2, 0, 25, 8], "score": 0.5}]}}, 20, 10)).collect()
    assert (r.x0, r.x1, r.y1, r.source_index, r.reading_order, r.error) == (0, 20, 8, 0, 0, None)


def test_missing_null_and_bad_items(spark):
    items = [{"label": "a", "coordinate": [0, 0, 5, 5], "score": 0.1}, {"label": "b", "coordinate": [0, 0, 5, 5], "order": None}, {"label": "c", "coordinate": [5, 0, 1, 5]}, {"label": "d", "coordinate": [0, 0, 5, 5], "order": 9}, {"coordinate": [0, 0, 5, 5]}]
    t = {r.raw_type: r for r in L.from_json_boxes(answers(spark, {"boxes": items}), threshold=0.3).collect()}
    assert "a" not in t and (t["b"].source_index, t["b"].order, t["b"].reading_order) == (0, 0, None) and (t["d"].source_index, t["d"].reading_order) == (1, 9)
    assert t["c"].error == "empty after clamping" and t[None].error == "no label"


def test_polygons(spark):
    items = [
        {"label": "heading", "polygon_points": [[2, 3], [7, 3], [7, 4], [2, 4]], "order": None, "coordinate": [2, 3, 7, 4]}, {"label": "text", "polygon_points": [2, 3, 7, 3, 7, 4], "order": 0},
        {"label": "flat", "polygon_points": [[0, 0], [1, 1], [2, 2]]}, {"label": "none"}, {"label": "odd", "polygon_points": [1, 2, 3, 4, 5]}, {"label": "wide", "coordinate": [3, 3, 4, 4], "polygon_points": [[2, 3], [7, 3], [7, 4]]},
    ]
    t = {r.raw_type: r for r in L.from_polygon_boxes(answers(spark, {"boxes": items}, 20, 10), (2, 0, -4, 0, 2, -6, 0, 0, 1)).collect()}
    h = t["heading"]
    assert (h.x0, h.y0, h.x1, h.y1) == (0, 0, 10, 2) and h.source_index == 0 and h.reading_order is None and h.crop_bbox is None and [(p.x, p.y) for p in h.polygon][:2] == [(0, 0), (10, 0)]
    assert t["text"].reading_order == 0 and t["text"].error is None and t["flat"].error == "degenerate polygon" and t["none"].error == "no coordinate and no polygon" and t["odd"].error.startswith("polygon")
    assert t["wide"].crop_bbox.asDict() == {"x0": 0, "y0": 0, "x1": 10, "y1": 2}


def test_layout_tokens(spark):
    one = "<|box_start|>10 20 900 800<|box_end|><|ref_start|>equation<|ref_end|><|rotate_right|>"
    (r,) = L.from_tokens(answers(spark, one, 200, 100)).collect()
    assert (r.x0, r.y0, r.x1, r.y1, r.rotation, r.raw_type, r.error) == (2, 2, 180, 80, 90, "equation", None)
    assert L.from_tokens(answers(spark, "<|box_start|>0 0 1000 1000<|box_end|><|ref_start|>t<|ref_end|>", 3_000_000, 1)).first().x1 == 3_000_000
    assert L.from_tokens(answers(spark, "some words")).first().error and L.from_tokens(answers(spark, " ")).count() == 0
    assert L.from_tokens(answers(spark, one + "<|box_start|>1")).first().error and L.from_tokens(answers(spark, one.replace("900", "1900"))).first().error


def test_otsl():
    assert C.otsl_html("<fcel>A&B<lcel><nl><ucel><xcel><nl>") == '<table>\n<tr><td rowspan="2" colspan="2">A&amp;B</td></tr>\n<tr></tr>\n</table>'
    assert C.otsl_html("<fcel>a\nb<ecel><nl>") == "<table>\n<tr><td>a<br/>b</td><td></td></tr>\n</table>" and C.otsl_html("plain") == "plain"
    for bad in ("<fcel>A<nl><xcel><nl>", "<fcel>A<fcel>B<nl><fcel>C<nl>", "<nl><fcel>a", "<lcel><fcel>a<nl>", "<fcel>A<lcel><nl><ucel><fcel>B<nl>"):
        with pytest.raises(ValueError):
            C.otsl_html(bad)


def test_csv():
    assert C.csv_html('﻿ID,Value,Note\n00123,=1+2,"a,b\n""quoted"" <&>"\n') == '<table>\n<tr><td>ID</td><td>Value</td><td>Note</td></tr>\n<tr><td>00123</td><td>=1+2</td><td>a,b<br>&quot;quoted&quot; &lt;&amp;&gt;</td></tr>\n</table>'
    assert C.csv_rows("a;b;", ";") == [["a", "b", ""]] and C.csv_rows("a\r\n\r\nb\r") == [["a"], [""], ["b"]] and C.csv_rows('"x\r\ny"') == [["x\ny"]] and C.csv_rows(",") == [["", ""]]
    for bad in ('"abc', '"a"b', 'a"b', b"\xff", "", "a\x01", "﻿"):
        with pytest.raises(ValueError):
            C.csv_rows(bad)
    with pytest.raises(ValueError):
        C.csv_rows("abc", most=2)
    with pytest.raises(ValueError):
        C.csv_rows("a", "x")


def test_ctc_and_tensor(spark):
    steps = [1, 1, 0, 1, 2]
    logits = [float(c == s) for s in steps for c in range(3)]
    t = spark.createDataFrame([(1, logits), (2, [])], "id bigint, logits array<double>")
    out = {r.id: r.t for r in t.select("id", C.ctc_text(C.ctc_steps(F.col("logits"), 3), F.array(F.lit(""), F.lit("A"), F.lit("中"))).alias("t")).collect()}
    assert out == {1: "AA中", 2: ""}
    t = spark.createDataFrame([(1, [0.0, 0.9, 0.0, 0.0, 2.0, 2.0, 7.0, 0.9, 0.0, 0.0, 1.0, 1.0]), (2, [])], "id bigint, data array<double>")
    out = L.from_tensor(t, ("text",), x_scale=10.0, y_scale=5.0).orderBy("source_index").collect()
    assert [(r.x1, r.y1, r.error is None) for r in out] == [(20, 10, True), (10, 5, False)]


def test_text_helpers(spark):
    t = spark.createDataFrame([("a <&> \"b\"\nc", "/data/in/x", "/data/in", "/data/../etc")], "t string, p string, root string, up string")
    r = t.select(T.escape_html(F.col("t"), True, "<br>").alias("e"), T.compact(F.lit("A b\tÄ\n")).alias("c"), T.under_root(F.col("p"), F.col("root")).alias("in"), T.under_root(F.col("up"), F.col("root")).alias("out"), T.under_root(F.lit("/data/inner"), F.col("root")).alias("near"), T.base64_plain(F.lit(bytearray(range(4)))).alias("b"), T.file_extension(F.lit("/a.b/C.TiFF")).alias("x")).first()
    assert tuple(r) == ("a &lt;&amp;&gt; &quot;b&quot;<br>c", "abÄ", True, False, False, "AAECAw==", ".tiff")
    t = spark.createDataFrame([("<TABLE a=1>\n<tr><td>x</td></tr> <tr><th>y</th><td/></tr></table>",), ("<table>x<tr></tr></table>",), ("<table><tr><table></table></tr></table>",), ("text",), (None,)], "t string")
    got = [(r.ok, r.n) for r in t.select(T.is_table(F.col("t")).alias("ok"), F.size(T.table_rows(F.col("t"))).alias("n")).collect()]
    assert got == [(True, 2), (False, None), (False, None), (False, None), (False, None)]


def test_fallback_and_error_policy(spark):
    regions = spark.createDataFrame([(1, 1, 0, ["a", "b"]), (1, 1, 1, ["a", "b"]), (2, 1, 0, ["b"])], "doc_id bigint, page int, source_index bigint, models array<string>")
    responses = spark.createDataFrame([(1, 0, "a", None, "HTTP 503"), (1, 0, "b", "ok", None), (1, 1, "a", None, "HTTP 503"), (1, 1, "b", None, "bad"), (2, 0, "b", "", None)], "doc_id bigint, source_index bigint, model string, response string, error string")
    out = R.first_success(regions, responses, ["doc_id", "source_index"])
    got = {(r.doc_id, r.source_index): (r.model, r.text, r.error) for r in out.collect()}
    assert got == {(1, 0): ("b", "ok", ""), (1, 1): (None, "", "all recognition models failed: a: HTTP 503; b: bad"), (2, 0): ("b", "", "")}
    record, fail = R.document_status(out, "record"), R.document_status(out, "fail")
    assert {r.doc_id: r.exit_code for r in record.collect()} == {1: 2, 2: 0} and {r.doc_id: r.exit_code for r in fail.collect()} == {1: 1, 2: 0}
    assert R.batch_exit_code(record).first()[0] == 2 and R.batch_exit_code(fail).first()[0] == 1


REGION = "doc_id bigint, page int, width int, height int, source_index bigint, type string, reading_order int, x0 double, y0 double, x1 double, y1 double, text string, error string, asset string"


def html(*rows):
    return "<table>\n" + "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>\n" for r in rows) + "</table>"


def pages_of(spark, *pages):
    return spark.createDataFrame([(1, n, 100, 100, i, kind, i, x0, y0, x1, y1, text, "", "") for n, regions in enumerate(pages, 1) for i, (kind, x0, y0, x1, y1, text) in enumerate(regions)], REGION)


def test_tables_across_three_pages(spark):
    t = pages_of(spark, [("text", 0.0, 0.0, 9.0, 9.0, "intro"), ("table", 0.0, 80.0, 99.0, 99.0, html("hx", "12"))], [("table", 0.0, 1.0, 99.0, 99.0, html("hx", "34"))], [("table", 0.0, 1.0, 99.0, 60.0, html("hX", "56")), ("text", 0.0, 61.0, 9.0, 70.0, "end")])
    for header in (False, True):
        got = {(r.page, r.source_index): r for r in R.stitched(t, header=header).collect()}
        assert got[1, 1].text == html("hx", "12", "34", "56") and got[1, 1].merged_pages == [2, 3] and got[2, 0].text == got[3, 0].text == ""
        assert (got[3, 0].merged_into.page, got[3, 0].merged_into.source_index) == (1, 1) and got[3, 1].text == "end" and got[1, 0].merged_pages is None


@pytest.mark.parametrize("second", [("table", 50.0, 1.0, 99.0, 60.0, html("ab")), ("table", 0.0, 20.0, 99.0, 60.0, html("ab")), ("text", 0.0, 1.0, 99.0, 60.0, html("ab")), ("table", 0.0, 1.0, 99.0, 60.0, html("abc")), ("table", 0.0, 1.0, 99.0, 60.0, html("ab").replace("<td>", '<td colspan="1">'))])
def test_tables_that_do_not_go_on(spark, second):
    t = pages_of(spark, [("table", 0.0, 80.0, 99.0, 99.0, html("ab", "cd"))], [second])
    assert all(r.merged_pages is None and r.merged_into is None and r.text for r in R.stitched(t).collect())


def test_a_chain_stops_where_more_follows_on_the_page(spark):
    t = pages_of(spark, [("table", 0.0, 80.0, 99.0, 99.0, html("ab"))], [("table", 0.0, 1.0, 99.0, 40.0, html("cd")), ("table", 0.0, 60.0, 99.0, 99.0, html("ef"))], [("table", 0.0, 1.0, 99.0, 50.0, html("gh"))])
    got = {(r.page, r.source_index): r for r in R.stitched(t).collect()}
    assert got[1, 0].text == html("ab", "cd") and got[2, 1].text == html("ef", "gh") and got[2, 1].merged_pages == [3] and got[2, 0].text == ""


CONFIG = {
    "version": 1, "models": {"finder": {"backend": "mock"}, "bad": {"backend": "mock", "fails": "HTTP 503"}, "reader": {"backend": "mock", "response": "hello", "batch_size": 4}, "tables": {"backend": "mock", "response": "<fcel>1<fcel>2<nl>"}},
    "layout": {"model": "finder", "provider": "paddle"}, "routes": {"table": {"models": ["bad", "tables"], "adapter": "table"}, "header": {"action": "skip"}, "*": {"models": ["bad", "reader"]}},
    "execution": {"on_error": "record"}, "postprocess": {"low_score": {"enabled": True}, "overlap": {"enabled": True}, "cross_page_tables": {"enabled": True}},
}


def test_pipeline(spark, tmp_path):
    page = lambda y0, y1: {"boxes": [{"label": "title", "coordinate": [0, 0, 50, 9], "score": 0.9, "order": 0}, {"label": "text", "coordinate": [1, 0, 50, 9], "score": 0.5, "order": 1}, {"label": "table", "coordinate": [0, y0, 99, y1], "order": 2}, {"label": "noise", "coordinate": [0, 20, 9, 30], "score": 0.1}]}
    second = page(1, 60)
    second["boxes"] = second["boxes"][2:]
    rows = [(7, 1, 100, 100, json.dumps(page(70, 99))), (7, 2, 100, 100, json.dumps(second))]
    p = Pipeline(CONFIG)
    out = p.documents(spark.createDataFrame(rows, ANSWER)).cache()
    (r,) = out.collect()
    assert r.markdown == "<!-- page: 1 -->\n\n# hello\n\n<table>\n<tr><td>1</td><td>2</td></tr>\n<tr><td>1</td><td>2</td></tr>\n</table>\n\n<!-- page: 2 -->\n\n"
    data = json.loads(r.json)
    assert (data["schema_version"], data["coordinate_system"]) == (2, "page_pixels_xyxy") and [(p["page"], p["width"], p["height"]) for p in data["pages"]] == [(1, 100, 100), (2, 100, 100)] and [b["id"] for b in data["pages"][0]["blocks"]] == ["p1-s0", "p1-s2"] and data["pages"][0]["blocks"][1]["extensions"]["merged_pages"] == [2]
    written = sinks.write_documents(out, str(tmp_path / "out")).collect()
    assert len(written) == 2 and (tmp_path / "out/7/document.md").read_text() == r.markdown and not list(tmp_path.rglob("*.part"))


def test_chat_answers(spark):
    good = {"choices": [{"finish_reason": "stop", "message": {"content": "x\"y"}}], "usage": {"total_tokens": 110, "completion_tokens": 10}}
    cut = {"choices": [{"finish_reason": "length", "message": {"content": "x"}}]}
    t = spark.createDataFrame([(json.dumps(good),), (json.dumps(cut),), ("{}",)], "r string")
    got = [(r.text, r.error, r.total_tokens) for r in t.select(C.chat_answer(F.col("r")).alias("a")).select("a.*").collect()]
    assert got == [('x"y', None, 110), (None, "the answer was cut short", None), (None, "no content", None)]
    body = t.limit(1).select(C.chat_payload(F.lit("m"), F.lit('a "b"\n'), F.lit("data:x")).alias("b")).first().b
    assert json.loads(body)["messages"][0]["content"][1] == {"type": "text", "text": 'a "b"\n'}


def test_registries():
    r = M.Registry("thing")
    r.add("a", lambda: 1)
    with pytest.raises(ValueError):
        r.add("a", lambda: 2)
    with pytest.raises(ValueError):
        r.get("b")
    assert M.default_decoder("table") == "table" and M.infer_batch(M.MockModel({"responses": {"p": "q"}}), [(None, "p"), (None, "z")]) == ["q", ""]


def test_configuration():
    c = validated(CONFIG)
    assert c["execution"]["page_workers"] == 4 and c["document"]["dpi"] == 150 and c["layout"]["max_boxes"] == 2000 and c["models"]["reader"]["max_concurrent_requests"] == 1
    two = {
        "version": 2, "executors": {"e": {"backend": "openai_chat", "max_inflight": 3, "served_model": "m", "url": "http://x"}}, "models": {"lay": {"executor": "e", "adapter": "paddle"}, "tab": {"executor": "e", "adapter": "table"}},
        "pipeline": {"layout": {"model": "lay"}, "routes": {"*": {"models": ["tab"]}, "figure": {"action": "save_crop"}}},
    }
    one = normalised(two)
    assert one["models"]["e"] == {"backend": "chat", "instances": 3, "model": "m", "url": "http://x"} and one["routes"]["*"]["binding_ids"] == {"e": "tab"} and one["routes"]["figure"]["action"] == "image"
    assert validated(two)["routes"]["*"]["adapter"] == "table"

    def broken(**change):
        return {**CONFIG, **change}

    for bad in (
        broken(version=3), broken(models={}), broken(layout={"model": "none"}), broken(routes={"*": {"models": ["none"]}}), broken(routes={"*": {"model": "reader", "models": ["reader"]}}), broken(routes={"*": {"action": "jump"}}),
        broken(execution={"workers": 0}), broken(execution={"speed": 1}), broken(postprocess={"low_score": {"threshold": 2}}), broken(postprocess={"magic": {}}), broken(document={"csv_delimiter": "x"}), broken(extra=1),
        broken(models=CONFIG["models"] | {"reader": {"backend": "mock", "batch_size": 300}}), broken(models=CONFIG["models"] | {"reader": {"backend": "mock", "input_resize": {"factor": 28, "max_width": 20}}}),
        {**two, "models": {"lay": {"executor": "none", "adapter": "x"}}},
    ):
        with pytest.raises(ConfigError):
            validated(bad)


def test_schema_2_json_of_every_conversation(spark, tmp_path):
    rows = [(c, n, ("user", "assistant", "system")[(c + n) % 3], f"text {c} {n}") for c in range(9) for n in range(3)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.doc_id: json.loads(r.json) for r in doc_queries.document_json_v2(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(9)) and all(d["schema_version"] == 2 and len(d["pages"][0]["blocks"]) == 3 for d in got.values())


def test_layout_errors_fail_their_documents(spark):
    good = {"label": "title", "coordinate": [0, 0, 50, 9], "score": 0.9}
    bad = {"label": "text", "coordinate": [9, 0, 1, 9], "score": 0.9}
    rows = [(1, 1, [good]), (2, 1, [good] * 4), (3, 1, [good]), (3, 2, [bad, good, bad]), (4, 1, [{"coordinate": [0, 0, 5, 5]}])]
    p = Pipeline({**CONFIG, "layout": {**CONFIG["layout"], "max_boxes": 3}})
    out = {r.doc_id: r for r in p.documents(spark.createDataFrame([(d, n, 100, 100, json.dumps({"boxes": b})) for d, n, b in rows], ANSWER)).collect()}
    assert {d: (r.status, r.exit_code, r.document_error) for d, r in out.items()} == {
        1: ("succeeded", 0, None), 2: ("failed", 1, "too many boxes"), 3: ("failed", 1, "empty after clamping"), 4: ("failed", 1, "no label"),
    }
    blocks = {d: [(b["id"], b["error"]) for page in json.loads(r.json)["pages"] for b in page["blocks"]] for d, r in out.items()}
    assert len(blocks[2]) == 4 and blocks[3] == [("p1-b0", ""), ("p2-b0", ""), ("p2-b1", "empty after clamping"), ("p2-b2", "empty after clamping")]
    assert out[1].markdown == "<!-- page: 1 -->\n\n# hello\n\n" and "failed" in out[3].markdown


def test_pages_without_boxes_and_routes_that_read_nothing(spark):
    box = {"label": "text", "coordinate": [0, 0, 9, 9]}
    rows = [(1, 1, 50, 60, json.dumps({"boxes": []})), (2, 1, 50, 60, json.dumps({"boxes": [box]})), (2, 2, 50, 60, json.dumps({"boxes": []}))]
    p = Pipeline({**CONFIG, "routes": {"*": {"action": "skip"}}})
    out = {r.doc_id: r for r in p.documents(spark.createDataFrame(rows, ANSWER)).collect()}
    assert out[1].markdown == "<!-- page: 1 -->\n\n" and out[1].status == "succeeded"
    assert json.loads(out[1].json) == {"schema_version": 1, "source": "", "coordinate_system": "page_pixels_xyxy", "pages": [{"page": 1, "width": 50, "height": 60, "blocks": []}]}
    assert [len(p["blocks"]) for p in json.loads(out[2].json)["pages"]] == [1, 0]


def test_other_layout_adapters(spark):
    tokens = "<|box_start|>100 100 500 500<|box_end|><|ref_start|>text<|ref_end|>"
    polygon = json.dumps({"boxes": [{"label": "text", "score": 0.9, "polygon_points": [[1, 1], [9, 1], [9, 9], [1, 9]], "order": None}]})
    for provider, response, version in (("mineru", tokens, 1), ("paddle.doclayout_v3.http", polygon, 2), ("pixel", json.dumps({"boxes": [{"type": "text", "bbox": [0, 0, 9, 9]}]}), 1)):
        p = Pipeline({**CONFIG, "layout": {"model": "finder", "provider": provider}})
        (r,) = p.documents(spark.createDataFrame([(1, 1, 100, 100, response)], ANSWER)).collect()
        data = json.loads(r.json)
        assert data["schema_version"] == version and data["pages"][0]["blocks"][0]["text"] == "hello" and r.status == "succeeded"
    assert data["pages"][0]["blocks"][0]["order"] == 0


def test_pipeline_sees_pixels(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 200, (40, 60, 3), dtype=np.uint8)
    found = [{"label": "figure", "coordinate": [0, 0, 30, 30], "score": 0.9}, {"label": "text", "coordinate": [5, 5, 15, 15], "score": 0.9}, {"label": "text", "coordinate": [40, 10, 55, 20], "score": 0.8}]
    config = {
        **CONFIG, "models": CONFIG["models"] | {"finder": {"backend": "mock", "response": json.dumps({"boxes": found})}}, "postprocess": {"composite": {"enabled": True}},
        "routes": {"figure": {"action": "image"}, "*": {"model": "reader", "save_crop": True}},
    }
    images = spark.createDataFrame([(1, 1, 60, 40, pixels.tobytes())], "doc_id bigint, page int, width int, height int, rgb binary")
    p = Pipeline(config)
    answers = p.detected(images)
    assert [json.loads(r.response) for r in answers.collect()] == [{"boxes": found}]
    (r,) = p.documents(answers, images).collect()
    blocks = {b["id"]: b for b in json.loads(r.json)["pages"][0]["blocks"]}
    assert blocks["p1-s0"]["asset"] == "assets/page-1-box-0.png" and blocks["p1-s0"]["extensions"]["composite_children"] == [1]
    assert [b["text"] for b in blocks.values()] == ["", "hello", "hello"] and blocks["p1-s3"]["extensions"]["recovered"] and blocks["p1-s3"]["provenance"] == {"layout_pass": 2}
    sinks.write_assets(p.assets(answers, images), str(tmp_path)).collect()
    (shown,) = images_module.decode((tmp_path / "1/assets/page-1-box-0.png").read_bytes())
    assert (shown == pixels[:30, :30]).all() and len(list((tmp_path / "1/assets").iterdir())) == 3


def test_services_keep_their_connection():
    seen, made = [], []

    class Service(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            made.append(1)
            super().setup()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            answer = {"results": [{"text": i["prompt"]} for i in body["items"]]} if "items" in body else {"boxes": []} if body.get("prompt") == "layout" else {"text": "x"}
            data = json.dumps(answer).encode()
            self.send_response(503 if body.get("prompt") == "busy" else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    m = M.JsonModel({"url": f"http://127.0.0.1:{server.server_port}/ask", "batch_requests": True})
    assert m.infer(b"png", "a") == "x" and json.loads(m.infer(None, "layout")) == {"boxes": []} and m.infer_batch([(None, "p"), (None, "q")]) == ["p", "q"]
    with pytest.raises(M.ModelError) as e:
        m.infer(None, "busy")
    assert e.value.kind == "http_503" and m.infer(None, "b") == "x" and len(made) == 1 and seen[0]["image"].startswith("data:image/png;base64,")
    server.shutdown()


def test_optional_sections_of_a_configuration():
    model = lambda **s: {**CONFIG, "models": CONFIG["models"] | {"reader": {"backend": "mock", "instances": 8, **s}}}
    visual = {"enabled": True, "max_num_seqs": 8, "max_model_len": 100, "max_num_batched_tokens": 100, "visual_pixels_per_token": 784, "cudagraph_capture_sizes": [1, 2, 8]}
    assert validated(model(visual_scheduler=visual))["models"]["reader"]["visual_scheduler"]["bucket_scan_limit"] == 256
    assert validated(model(adaptive_concurrency={"enabled": True}))["models"]["reader"]["adaptive_concurrency"]["token_budget"] == 32_768
    assert validated({**CONFIG, "execution": {"async_recognition": {"enabled": True}}})["execution"]["async_recognition"]["max_requests"] == 256
    for bad in (
        model(adaptive_concurrency={"enabled": True, "initial_concurrency": 9}), model(adaptive_concurrency={"backoff_ratio": 1.0}), model(adaptive_concurrency={"token_budget": 0}), model(adaptive_concurrency={"enabled": True, "initial_token_budget": 10**6}),
        model(visual_scheduler={**visual, "cudagraph_capture_sizes": [2, 2]}), model(visual_scheduler={**visual, "cudagraph_capture_sizes": [9]}), model(visual_scheduler={"enabled": True}), model(visual_scheduler={**visual, "bucket_mode": "static"}),
        {**CONFIG, "execution": {"async_recognition": {"workers": 0}}}, {**CONFIG, "execution": {"async_recognition": {"speed": 1}}},
    ):
        with pytest.raises(ConfigError):
            validated(bad)


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_packed_documents(spark):
    word = packed(word__document_dot_xml='<w:document xmlns:w="w"><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:document>')
    book = packed(o__book_dot_opf='<package><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>', o__a_dot_xhtml="<html><p>last</p></html>", o__b_dot_xhtml="<html><h1>first</h1></html>")
    odt = packed(content_dot_xml='<d xmlns:t="t"><t:h>head</t:h><t:p>body</t:p></d>')
    bomb = packed(content_dot_xml='<!DOCTYPE d [<!ENTITY a "b">]><d>&a;</d>')
    t = spark.createDataFrame([("w", ".docx", word), ("b", ".epub", book), ("o", ".odt", odt), ("x", ".odt", bomb), ("z", ".docx", b"no"), ("e", ".pdf", b"")], "path string, ext string, content binary")
    got = sorted(((r.path, r.source_index, r.type, r.text, r.error is not None) for r in files.packed_blocks(t).collect()), key=repr)
    assert got == [("b", 0, "title", "first", False), ("b", 1, "text", "last", False), ("o", 0, "title", "head", False), ("o", 1, "text", "body", False), ("w", 0, "text", "one two", False), ("w", 1, "text", "three", False), ("x", None, None, None, True), ("z", None, None, None, True)]
