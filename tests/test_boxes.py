"""Box operators against small plain-Python models."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import boxes as B

BOX = "doc_id bigint, page int, source_index bigint, type string, raw_type string, x0 double, y0 double, x1 double, y1 double, score double, reading_order int"


def make(spark, rows):
    return spark.createDataFrame([(r.get("doc_id", 1), 1, r["i"], r["type"], r["type"], *map(float, r["box"]), r.get("score", 0.9), r.get("order", r["i"])) for r in rows], BOX)


def indices(df):
    return sorted(r.source_index for r in df.collect())


def area(b):
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def both(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def iou(a, b):
    u = area(a) + area(b) - both(a, b)
    return both(a, b) / u if u > 0 else 0


def test_label_decides_and_a_clear_score_difference_wins(spark):
    table, text = {"i": 0, "type": "table", "box": (0, 0, 20, 20), "score": 0.65}, {"i": 1, "type": "text", "box": (1, 1, 19, 19), "score": 0.85}
    assert indices(B.without_overlaps(make(spark, [table, text]))) == [0]
    for score in (0.96, 0.95):
        assert indices(B.without_overlaps(make(spark, [table, text | {"score": score}]))) == [1]


def plain_dedup(rows, threshold=0.5, margin=0.3):
    rank = {t: len(B.LABEL_PRIORITY) - k for k, t in enumerate(B.LABEL_PRIORITY)}

    def wins(a, b):
        if abs(a["score"] - b["score"]) + 1e-9 >= margin and a["score"] != b["score"]:
            return a["score"] > b["score"]
        pa, pb = rank.get(a["type"], 0), rank.get(b["type"], 0)
        return pa > pb if pa != pb else a["score"] > b["score"] if a["score"] != b["score"] else a["i"] < b["i"]

    rows = sorted(rows, key=lambda r: (r["order"] is None, r["order"] or 0, r["i"]))
    gone = set()
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            if a["i"] in gone:
                break
            if b["i"] not in gone and iou(a["box"], b["box"]) >= threshold:
                gone.add(b["i"] if wins(a, b) else a["i"])
    return {r["i"] for r in rows} - gone


def plain_parents(rows):
    out = {}
    for a in rows:
        outer = [(area(b["box"]), b["i"]) for b in rows if b is not a and area(a["box"]) > 0 and area(b["box"]) > 1.05 * area(a["box"]) and both(a["box"], b["box"]) / area(a["box"]) >= 0.9]
        out[a["i"]] = min(outer)[1] if outer else None
    return out


def plain_composites(rows, inspect=False):
    parent, by = plain_parents(rows), {r["i"]: r for r in rows}

    def above(i):
        while (i := parent[i]) is not None:
            yield i

    semantic = {a for r in rows if r["type"] in B.EXPAND for a in above(r["i"])}
    holders = {i for i in by if by[i]["type"] in B.OUTER and i in parent.values()}
    kept = {i for i in holders if by[i]["score"] >= 0.7 and i not in semantic}
    out = set(by) - (holders - kept)
    children = {}
    for i in by:
        h = next((a for a in above(i) if a in kept), None)
        if h is not None:
            children.setdefault(h, []).append(i)
            if not inspect:
                out.discard(i)
    return out, {k: sorted(v) for k, v in children.items() if k in out}, {i: parent[i] for i in out if parent[i] in holders - kept}


def pages(seed, n_pages, n):
    rng = random.Random(seed)
    out = []
    for page in range(n_pages):
        rows = []
        for i in range(n):
            x, y, w, h = rng.randrange(60), rng.randrange(60), rng.randrange(0, 60), rng.randrange(1, 60)
            rows.append({"doc_id": page, "i": i, "type": rng.choice(["text", "table", "chart", "figure", "title", "odd"]), "box": (x, y, x + w, y + h), "score": rng.choice([0.2, 0.5, 0.69, 0.7, 0.8, 1.0]), "order": rng.choice([None, i, n - i])})
        out.append(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_pages_agree_with_the_plain_models(spark, seed):
    all_pages = pages(seed, 60, 12)
    t = make(spark, [r for p in all_pages for r in p]).cache()
    kept = {p[0]["doc_id"]: set() for p in all_pages}
    for r in B.without_overlaps(t).collect():
        kept[r.doc_id].add(r.source_index)
    assert all(kept[p[0]["doc_id"]] == plain_dedup(p) for p in all_pages)
    parents = {(r.doc_id, r.source_index): r.parent for r in B.forest(t).collect()}
    assert parents == {(p[0]["doc_id"], i): v for p in all_pages for i, v in plain_parents(p).items()}
    for inspect, name in ((False, "composite_children"), (True, "provisional_children")):
        got = B.composites(t, inspect=inspect).collect()
        for p in all_pages:
            want, children, freed = plain_composites(p, inspect)
            mine = [r for r in got if r.doc_id == p[0]["doc_id"]]
            assert {r.source_index for r in mine} == want
            assert {r.source_index: list(r[name]) for r in mine if r[name]} == children
            assert {r.source_index: r.parent_source_index for r in mine if r.parent_source_index is not None} == freed


def test_composite_examples(spark):
    chart, text = {"i": 0, "type": "chart", "box": (10, 10, 70, 70), "score": 0.9}, {"i": 1, "type": "text", "box": (20, 20, 30, 30), "score": 0.85}
    formula = {"i": 2, "type": "formula", "box": (25, 25, 29, 29)}
    assert indices(B.composites(make(spark, [chart, text]))) == [0]
    low = B.composites(make(spark, [chart | {"score": 0.5}, text])).collect()
    assert [(r.source_index, r.parent_source_index) for r in low] == [(1, 0)]
    assert indices(B.composites(make(spark, [chart, text, formula]))) == [1, 2]


@pytest.mark.parametrize("outer, inner, kept", [("chart explanation", "missing data", [1]), ("missing  DATA here", "Missing data", [0]), ("", "word", [1]), ("abc", "xyz", [0]), ("abc", "äé", [1])])
def test_finalisation(spark, outer, inner, kept):
    chart, text = {"i": 0, "type": "chart", "box": (10, 10, 70, 70), "score": 0.9}, {"i": 1, "type": "text", "box": (20, 20, 30, 30)}
    t = B.ordered(B.composites(make(spark, [chart, text]), inspect=True)).drop("parent_source_index")
    t = t.withColumns({"text": F.when(F.col("source_index") == 0, outer).otherwise(inner), "error": F.lit("")})
    out = B.finalised(t).collect()
    assert [r.source_index for r in out] == kept
    assert (out[0].parent_source_index, out[0].composite_children) == ((0, None) if kept == [1] else (None, [1]))


def test_recovered_boxes(spark):
    boxes = make(spark, [{"i": 0, "type": "chart", "box": (10, 10, 70, 70)}, {"i": 4, "type": "text", "box": (20, 20, 30, 30)}])
    found = make(spark, [{"i": 0, "type": "text", "box": (80, 80, 90, 90)}, {"i": 1, "type": "text", "box": (60, 60, 72, 72)}, {"i": 2, "type": "header", "box": (80, 0, 90, 9)}, {"i": 3, "type": "text", "box": (80, 20, 90, 30), "score": 0.2}, {"i": 5, "type": "text", "box": (80, 40, 80, 50)}])
    masked = B.masks(B.forest(boxes))
    out = B.recovered(boxes, found, masked).collect()
    assert sorted((r.source_index, r.x0) for r in out if r.recovered) == [(5, 80.0)]


def test_validation_and_page_limit(spark):
    t = make(spark, [{"i": k, "type": "text", "box": b, "score": s} for k, (b, s) in enumerate([((0, 0, 5, 5), 0.5), ((float("nan"), 0, 5, 5), 0.5), ((0, 0, 5, 5), 1.5), ((5, 0, 5, 5), 0.5), ((30, 0, 40, 5), 0.5), ((0, 0, float("inf"), 5), 0.5)])])
    t = t.withColumn("rotation", F.lit(90))
    got = {r.source_index: r.e for r in t.withColumn("e", B.geometry_error(F.lit(20), F.lit(10))).collect()}
    assert got == {0: None, 1: "coordinates not finite", 2: "score out of range", 3: "empty after clamping", 4: "empty after clamping", 5: "coordinates not finite"}
    assert {r.page_error for r in B.page_error(t, 5).collect()} == {"too many boxes"} and {r.page_error for r in B.page_error(t, 6).collect()} == {None}


def test_plans_shuffle_boxes_once(spark):
    t = make(spark, [r for p in pages(3, 5, 4) for r in p]).repartition("doc_id", "page")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = B.without_overlaps(B.composites(B.header_footer(B.low_score(t))))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange") == 1 and "Join" not in plan
