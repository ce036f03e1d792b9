"""Costs, buckets, replays, jobs, images, files and streams."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.functions import images as I
from pagemill.operators import jobs as J
from pagemill.operators import scheduling as S
from pagemill.operators import tensors as TN
from pagemill.operators.models import ModelError
from pagemill.sources import files
from pagemill.streaming import files as stream


def size_of(spark, w, h, **r):
    out = S.input_size(spark.range(1), F.lit(w), F.lit(h), S.Resize(**r)).first()["size"]
    return out.w, out.h


def test_input_size(spark):
    assert size_of(spark, 100, 60, max_width=40, max_height=40, max_pixels=1000) == (40, 24)
    w, h = size_of(spark, 10, 2000, factor=28)
    assert (w, h) == (28, 5600)
    for a, b in ((333, 77), (29, 1000), (5000, 4000)):
        w, h = size_of(spark, a, b, factor=28, min_pixels=3136, max_pixels=100_352)
        assert w % 28 == h % 28 == 0 and 3136 <= w * h <= 100_352
    with pytest.raises(ValueError):
        S.Resize(factor=28, max_width=20).bounds()


def buckets(spark, rows, widths, capacity, budget):
    t = spark.createDataFrame([("m", i, v, p) for i, (v, p) in enumerate(rows)], "model string, ticket bigint, visual bigint, prefill bigint")
    out = S.visual_buckets(t, widths, capacity, budget).orderBy("rank").collect()
    groups = {}
    for r in out:
        groups.setdefault(r.bucket, []).append(r.visual)
    return out[0].capture_size, [groups[k] for k in sorted(groups)]


def plain_buckets(rows, widths, capacity, budget):
    rows = sorted(rows, key=lambda r: r[0])
    size, anchor = 1, 0
    for w in sorted(widths):
        if w <= min(capacity, len(rows)):
            fit = [(sum(p for _, p in rows[i : i + w]), -i) for i in range(len(rows) - w + 1) if sum(p for _, p in rows[i : i + w]) <= budget]
            if fit:
                size, anchor = w, -max(fit)[1]
    cut = lambda part: [[v for v, _ in part[i : i + size]] for i in range(0, len(part), size)]
    return size, cut(rows[:anchor]) + cut(rows[anchor : anchor + size]) + cut(rows[anchor + size :])


def test_visual_buckets(spark):
    rows = [(v, 20 + v) for v in range(1, 17)]
    size, groups = buckets(spark, rows, (1, 2, 4, 8), 16, 320)
    assert size == 8 and len(groups) == 2
    size, groups = buckets(spark, rows, (1, 2, 4, 8), 16, 110)
    assert size == 4 and len(groups) == 5 and groups[2] == [6, 7, 8, 9]
    size, groups = buckets(spark, [(1, 80)] + [(v, 10) for v in range(2, 10)], (1, 2, 4, 8), 16, 40)
    assert [len(g) for g in groups] == [1, 4, 4] and groups[1][0] == 2
    assert buckets(spark, [(5, 1000), (6, 1000)], (1, 2), 4, 100) == (1, [[5], [6]])
    rng = random.Random(4)
    for _ in range(6):
        rows = [(rng.randrange(50), rng.randrange(1, 60)) for _ in range(rng.randrange(1, 20))]
        assert buckets(spark, rows, (1, 2, 4, 8), 8, 120)[0] == plain_buckets(rows, (1, 2, 4, 8), 8, 120)[0]
        assert [len(g) for g in buckets(spark, rows, (1, 2, 4, 8), 8, 120)[1]] == [len(g) for g in plain_buckets(rows, (1, 2, 4, 8), 8, 120)[1]]


def test_admission_conserves_jobs(spark):
    log = spark.createDataFrame([("a", i, float(i), 0.0, 1000.0, 0) for i in range(50)] + [("b", 100 + i, 10.0 * i, 2.0, 3.0, 10) for i in range(5)] + [("c", 200 + i, float(i), 100.0, 1.0, 600) for i in range(3)], "server string, job bigint, arrival_ms double, upload_ms double, service_ms double, bytes bigint")
    got = {r.job: (r.decision, r.reason) for r in S.admission(log, 100, 2, 1000).collect()}
    assert sum(d == ("429", "active job limit") for j, d in got.items() if j < 50) == 48 and all(got[100 + i] == ("202", None) for i in range(5))
    assert [got[200 + i] for i in range(3)] == [("202", None), ("429", "upload byte limit"), ("429", "upload byte limit")]
    few = {r.job: r.reason for r in S.admission(log.where("server = 'b'"), 3, 1, 1000).collect()}
    assert [few[100 + i] for i in range(5)] == [None, None, None, "cumulative job limit", "cumulative job limit"]


def test_recognition_pool(spark):
    rows = [("a", i, 0.0, 100.0, 10) for i in range(6)] + [("a", 10, 1.0, 1.0, 1000), ("a", 11, 2.0, 1.0, 10), ("b", 20, 5.0, 1.0, 100)]
    log = spark.createDataFrame(rows, "server string, request bigint, arrival_ms double, service_ms double, bytes bigint")
    got = {r.request: (r.outcome, r.started_ms) for r in S.recognition_pool(log, workers=2, max_requests=4, max_bytes=100, timeout_ms=150.0).collect()}
    assert [got[i] for i in range(4)] == [("done", 0.0), ("done", 0.0), ("done", 100.0), ("done", 100.0)] and got[4] == got[5] == ("done", 200.0)
    assert got[10] == ("oversize", None) and got[11] == ("timeout", None) and got[20] == ("done", 5.0)


def test_tensor_models():
    labels = ["", "A", "中"]

    def engine(inputs):
        assert inputs["x"].shape == (2, 3, 4, 5) and inputs["shape"].shape == (2, 2)
        return [np.tile(np.eye(3, dtype=np.float32)[[1, 1, 0, 1, 2]], (2, 1, 1))]

    m = TN.TensorModel({"engine": engine, "inputs": [{"name": "x", "shape": (2, 3, 4, 5)}, {"name": "shape", "shape": (-1, 2), "kind": "original_shape"}], "static_batch": 2, "vocabulary": labels})
    assert m.infer_batch([(I.encode_png(PICTURE), "")] * 3) == ["AA中"] * 3
    for bad in ({"y": np.zeros((1, 2), np.float32)}, {"x": np.zeros((1, 2))}, {"x": np.zeros((1, 3), np.float32)}):
        with pytest.raises(ModelError):
            TN.bound([TN.Input("x", (1, 2))], bad)
    assert TN.layout_items(np.array([[0, 0.9, 0, 0, 2, 2]]), ["t"], 0.5, 10, 5)[0]["coordinate"] == [0, 0, 20, 10] and TN.layout_items(np.zeros((0, 6)), ["t"], 0.5, 1, 1) == []
    with pytest.raises(ModelError):
        TN.ctc(np.zeros((1, 2, 2)), labels)


def test_submission(spark):
    t = spark.createDataFrame([(0, "/in/a.png", 1), (1, "/inside/a.png", 1), (2, "/in/../x.png", 1), (3, "/in/a.exe", 1), (4, "/in/b/c.PDF", 2_000_000)], "arrival bigint, path string, priority int")
    got = [(r.sequence, r.state, r.error) for r in J.submitted(t, "/in", 7).orderBy("arrival").collect()]
    assert got == [(7, "queued", None), (8, "failed", "path outside the allowed root"), (9, "failed", "path outside the allowed root"), (10, "failed", "unsupported extension"), (11, "failed", "priority out of range")]


def windows(c, *rates, start=0.0, blocked=True):
    """Feeds a controller one window of two requests for each rate (work a window)."""
    at, budgets = start, []
    for rate in rates:
        for k in range(2):
            at += 50
            c.observe(at, rate / 2, blocked=blocked)
        budgets.append(c.budget)
    return at, budgets


def test_controller_grows_and_returns():
    c = S.Controller(budget=1000, least=500, most=8000, window_ms=100, min_samples=2, cooldown_ms=150)
    at, budgets = windows(c, 10, 20, 22, 22.1)
    assert budgets == [2000, 4000, 8000, 4000] and c.state == "hold" and c.quiet_until == at + 150  # a flat probe goes back
    at, budgets = windows(c, 22, 22, start=at)
    assert budgets == [4000, 4400] and c.state == "probe"  # growth waits for the cooldown
    at, budgets = windows(c, 10, start=at)
    assert budgets == [3740] and c.state == "hold"  # a loss backs off
    assert windows(S.Controller(budget=1000, window_ms=100, min_samples=2), 10, 20, blocked=False)[1] == [1000, 1000]  # no demand


def test_controller_at_the_ceiling_overload_and_failures():
    c = S.Controller(budget=1000, least=500, most=1000, window_ms=100, min_samples=2, cooldown_ms=0)
    at, budgets = windows(c, 10, 10, 10, 10)
    assert budgets == [1000, 900, 900, 991]  # less is tried, and as fast: it stays, then grows again
    c = S.Controller(budget=1000, least=500, most=9000, window_ms=100, min_samples=2, cooldown_ms=50)
    c.observe(10, 1, failed=True, overload=True, inflight=2)
    assert (c.budget, c.state, c.epoch, c.stale) == (850, "hold", 1, 2)
    c.observe(20, 1, epoch=0, inflight=1)
    c.observe(30, 1, epoch=0, inflight=0)
    assert c.stale == 0 and c.seen == S.Sample(30)  # requests of the old epoch free their places and don't count
    for k in range(4):
        c.observe(80 + 50 * k, 1, failed=True, epoch=1)
    assert c.budget == 722 and c.state == "hold"


def test_controller_replay(spark):
    rows = [("m", k, 10.0 * k, 10.0 * k + 25, 5.0, False, False, True, True) for k in range(40)]
    log = spark.createDataFrame(rows, "model string, ticket bigint, started_ms double, at_ms double, work double, failed boolean, overload boolean, waiting boolean, blocked boolean")
    got = [(r.ticket, r.state, r.budget) for r in S.replay_controller(log, budget=1000, least=1, most=4000, window_ms=50, min_samples=2, cooldown_ms=10).orderBy("ticket").collect()]
    assert len(got) == 40 and got[0][2] == 1000 and {b for _, _, b in got} >= {1000, 2000} and max(b for _, _, b in got) <= 4000
    assert S.head_of_line([(1, 50), (2, 500), *((k, 1) for k in range(3, 12))], 100) == [1, 3, 4, 5, 6]


def test_next_wave(spark):
    rows = [("m", t, v, p, b, 0.0) for t, v, p, b in ((1, 9, 50, 0), (2, 1, 30, 0), (3, 2, 30, 0), (4, 3, 30, 0), (5, 8, 90, 0), (6, 7, 20, 0))]
    t = spark.createDataFrame(rows, "model string, ticket bigint, visual bigint, prefill bigint, bypasses int, queued_ms double")
    one = lambda t, **o: tuple(S.next_wave(t, (1, 2, 3), 3, 100, 1.0, 10.0, **o).first())
    assert one(t) == ("m", 0, False, 3, [2, 3, 4])  # three requests fit the budget
    assert one(t.withColumn("bypasses", F.lit(4))) == ("m", 1, True, 3, [1, 6, 2])  # the oldest is first, then its bucket, then the queue
    assert one(t, scan_limit=1)[4] == [1] and one(t, free=2)[4] == [2, 3]


def test_costs(spark):
    r = spark.range(1).select(S.token_estimate(F.lit(28), F.lit(29), F.lit("äbcde"), output=10).alias("e"), S.visual_cost(F.lit(28), F.lit(29), 5).alias("v"), S.prefill(F.lit(7), F.lit("äbcde")).alias("p"), S.static_bucket(F.lit(16), (16, 32)).alias("b"), S.ewma_scale(F.array(F.lit(2.0), F.lit(100.0))).alias("w")).first()
    assert tuple(r)[:4] == (64 + 2 + 10 + 2, 7, 64 + 2 + 7, 1) and abs(r.w - (0.8 * 1.2 + 0.2 * 4)) < 1e-12


def test_jobs(spark):
    t = spark.createDataFrame([(i, p, s, 10) for i, (p, s) in enumerate([(0, "queued"), (5, "queued"), (5, "succeeded"), (-1, "processing"), (9, "cancelled")])], "sequence bigint, priority int, state string, upload_bytes bigint")
    assert [r.sequence for r in J.by_priority(t).orderBy("turn").collect()] == [4, 1, 2, 0, 3]
    assert [r.sequence for r in J.listing(t, "queued", 1, 5).collect()] == [1]
    s = J.state_counts(t).first()
    assert (s.admitted, s.active, s.conserved) == (5, 3, True)
    assert {r.sequence: (r.state, r.code) for r in J.cancelled(t, F.lit(True)).collect()} == {0: ("cancelled", 200), 1: ("cancelled", 200), 2: ("succeeded", 409), 3: ("cancelling", 202), 4: ("cancelled", 200)}
    assert {r.sequence for r in J.deleted(t, F.col("sequence") > 1).collect()} == {0, 1, 3}
    with pytest.raises(ValueError):
        J.listing(t, "odd")
    with pytest.raises(ValueError):
        J.listing(t, limit=201)
    bins = [r.b for r in spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (1 << 21,)], "n bigint").select(J.power_bin(F.col("n")).alias("b")).collect()]
    assert bins == [1, 2, 4, 4, 8, 1 << 20]
    state = lambda s, r, o, p: spark.range(1).select(J.next_state(F.lit(s), F.lit(r), F.lit(o), F.lit(p), F.lit(False))).first()[0]
    assert [state("reading", True, 0, 0), state("reading", True, 0, 2), state("cancelling", True, 0, 1), state("cancelling", False, 1, 1), state("queued", False, 0, 0), state("succeeded", True, 0, 0)] == ["failed", "finalizing", "cancelled", "cancelling", "reading", "succeeded"]


PICTURE = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3) * 4


def filtered_png(image, kind):
    h, w, _ = image.shape
    rows, above = [], np.zeros(w * 3, int)
    for y in range(h):
        line = image[y].reshape(-1).astype(int)
        left, corner = np.concatenate([[0] * 3, line[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return I.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def tiff(pages):
    out, heads = b"II*\0\0\0\0\0", []
    for p in pages:
        at = len(out)
        out += p.tobytes()
        heads.append((at, p))
    last = 4
    for at, p in heads:
        place = len(out)
        out = out[:last] + struct.pack("<I", place) + out[last + 4 :]
        bits = place + 2 + 9 * 12 + 4
        tags = [(256, 4, 1, p.shape[1]), (257, 4, 1, p.shape[0]), (258, 3, 3, bits), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, at), (277, 3, 1, 3), (278, 4, 1, p.shape[0]), (279, 4, 1, p.size)]
        out += struct.pack("<H", 9) + b"".join(struct.pack("<HHII", *t) for t in tags)
        last = len(out)
        out += b"\0\0\0\0" + struct.pack("<HHH", 8, 8, 8)
    return out


def test_image_formats():
    assert (I.decode(I.encode_png(PICTURE))[0] == PICTURE).all()
    assert all((I.decode(filtered_png(PICTURE, k))[0] == PICTURE).all() for k in range(5))
    assert (I.decode(b"P6 # note\n5 4\n255\n" + PICTURE.tobytes())[0] == PICTURE).all()
    assert (I.decode(b"P5 2 1 255\n\x07\x09")[0] == [[[7] * 3, [9] * 3]]).all()
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 0, 0, 54, 40, 5, 4, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(PICTURE[y, :, ::-1].tobytes() + b"\0" for y in range(3, -1, -1))
    assert (I.decode(bmp)[0] == PICTURE).all()
    tga = bytes([0, 0, 2]) + bytes(9) + struct.pack("<HHBB", 5, 4, 24, 32) + PICTURE[..., ::-1].tobytes()
    assert (I.decode(tga)[0] == PICTURE).all()
    two = I.decode(tiff([PICTURE, PICTURE[::-1].copy()]))
    assert len(two) == 2 and (two[0] == PICTURE).all() and (two[1] == PICTURE[::-1]).all()
    for bad in (b"P6 10001 10000 255\n", b"", b"junk", I.encode_png(PICTURE)[:60], tiff([PICTURE])[:80], b"P6 5 4 255\n123"):
        with pytest.raises(ValueError):
            I.decode(bad)
    assert I.on_white(np.array([[[10, 20, 30, 0], [10, 20, 30, 255]]], np.uint8)).tolist() == [[[255] * 3, [10, 20, 30]]]
    assert I.unpack_bits(b"\x02abc\xfex\x80") == b"abcxxx"


def test_image_operators():
    assert I.crop(PICTURE, (1.2, 0, 2.1, 1e300)).shape == (4, 2, 3)
    for bad in ((float("nan"), 0, 1, 1), (9, 0, 12, 1), (2, 0, 1, 1)):
        with pytest.raises(ValueError):
            I.crop(PICTURE, bad)
    assert (I.rotate(np.array([[[1] * 3, [2] * 3]], np.uint8), 90) == [[[2] * 3], [[1] * 3]]).all()
    assert (I.resize(PICTURE, 5, 4) == PICTURE).all() and I.resize(np.array([[[0] * 3, [255] * 3]], np.uint8), 4, 1)[0, :, 0].tolist() == [0, 64, 191, 255]
    masked = I.polygon_crop(PICTURE, (0, 0, 4, 4), [(0, 0), (4, 0), (0, 4)], 7)
    assert (masked[3, 3] == 7).all() and (masked[0, 0] == PICTURE[0, 0]).all()
    with pytest.raises(ValueError):
        I.polygon_crop(PICTURE, (0, 0, 4, 4), None)
    assert (I.white_out(PICTURE, [(0.5, 0.5, 1.5, 9)])[:, :2] == 255).all()
    t = I.tensor(PICTURE, 5, 4, bgr=True)
    assert t.shape == (1, 3, 4, 5) and np.isclose(t[0, 0, 0, 0], PICTURE[0, 0, 2] / 255)
    joined, n = I.batched([t, t + 1], 4)
    assert joined.shape[0] == 4 and n == 2 and (joined[3] == t + 1).all() and len(I.unbatched(joined, n)) == 2
    assert I.shape_size([2, 3]) == 6 and I.consistent(b"123", 1, 1) and I.data_url(PICTURE).startswith("data:image/png;base64,iVBOR")
    with pytest.raises(ValueError):
        I.shape_size([1 << 62, 4])


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(I.encode_png(PICTURE))
    (tmp_path / "b.tiff").write_bytes(tiff([PICTURE, PICTURE]))
    (tmp_path / "c.ppm").write_bytes(b"P6 9 9 255\n")
    (tmp_path / "d.csv").write_bytes(b"a,b\n")
    (tmp_path / "e.docx").write_bytes(b"PK")
    (tmp_path / "f.xyz").write_bytes(b"?")
    t = files.read_files(spark, str(tmp_path))
    assert sorted(r.ext for r in t.collect()) == [".csv", ".docx", ".png", ".ppm", ".tiff"] and len(files.EXTENSIONS) == 25
    pages = files.image_pages(t.where(F.col("ext").isin(*files.NATIVE))).collect()
    assert sorted((r.path.rpartition("/")[2], r.page, r.error is None) for r in pages) == [("a.PNG", 1, True), ("b.tiff", 1, True), ("b.tiff", 2, True), ("c.ppm", 1, False)]
    assert files.csv_tables(t.where("ext = '.csv'")).first().html == "<table>\n<tr><td>a</td><td>b</td></tr>\n</table>"
    assert files.needs_converter(t).first().error == "no converter for .docx"
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": [{"input": "x.png", "output": "o", "priority": -10}]}))
    assert files.read_manifest(spark, str(tmp_path / "jobs.json")).first().priority == -10
    (tmp_path / "bad.json").write_text('[{"input": "x"}]')
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "bad.json"))
    (tmp_path / "v.txt").write_bytes(b"a\r\nb\n")
    assert files.read_vocabulary(spark, str(tmp_path / "v.txt")) == ["a", "b"]
    info = "Pages:          3\nPage    1 size:  612 x 792 pts\nPage    2 size:  7200 x 792 pts\n"
    p = spark.range(1).select(files.pdf_plan(F.lit(info), max_pixels=1_000_000).alias("p"), files.pdf_plan(F.lit(info), max_pages=2).alias("q")).first()
    assert (p.p.pages, p.p.scale_to, p.p.error, p.q.error, p.q.scale_to) == (3, 1000, None, "too many pages", 6324)


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for n in range(2):
        (src / f"{n}.json").write_text(json.dumps({"doc_id": n, "page": 1, "width": 10, "height": 10, "response": "{}"}))
    q = stream.each_batch(stream.arriving_answers(spark, str(src), 1), lambda b: b.select("doc_id"), str(out), str(tmp_path / "cp"))
    assert q.awaitTermination(90) and sorted(r.doc_id for r in spark.read.parquet(str(out)).collect()) == [0, 1]
    events = tmp_path / "events"
    events.mkdir()
    rows = [("a", "queued", None), ("a", "page", None), ("a", "done", None), ("a", "read", 1), ("b", "read", 0), ("c", "page", None), ("d", "cancel", None), ("d", "done", None)]
    (events / "1.json").write_text("\n".join(json.dumps({"job": j, "kind": k, "n": n}) for j, k, n in rows))
    q = stream.job_states(spark.readStream.schema("job string, kind string, n bigint").json(str(events))).writeStream.outputMode("update").format("memory").queryName("job_states").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {r.job: r.state for r in spark.table("job_states").collect()} == {"a": "succeeded", "b": "failed", "c": "processing", "d": "cancelled"}
