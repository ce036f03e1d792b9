"""Planning of model requests: costs, input sizes, visual buckets and waves, and replays of admission and of the adaptive budget."""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("bigint")


def pixels(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1), width).cast("bigint") * F.greatest(F.lit(1), height).cast("bigint")


def prompt_tokens(prompt: Column) -> Column:
    """A quarter of the prompt's UTF-8 bytes, rounded up."""
    return ceil_div(F.octet_length(prompt).cast("bigint"), 4)


def token_estimate(width: Column, height: Column, prompt: Column, output: int = 512, pixels_per_token: int = 784, scale: Column | float = 1.0) -> Column:
    raw = 64 + prompt_tokens(prompt) + output + ceil_div(pixels(width, height), pixels_per_token)
    return F.greatest(F.lit(1.0), F.ceil(raw.cast("double") * scale).cast("double")).cast("bigint")


def visual_cost(width: Column, height: Column, overhead: int = 0, pixels_per_token: int = 784, cap: int = 1_000_000) -> Column:
    return F.least(F.lit(cap).cast("bigint"), overhead + ceil_div(width.cast("bigint") * height.cast("bigint"), pixels_per_token))


def prefill(visual: Column, prompt: Column, overhead: int = 64) -> Column:
    return overhead + prompt_tokens(prompt) + visual


def static_bucket(visual: Column, bounds: tuple[int, ...]) -> Column:
    """How many bucket bounds the cost reaches."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(visual >= b, 1).otherwise(0)
    return out


@dataclass(frozen=True)
class Resize:
    """Bounds of a model's input size."""

    factor: int = 1
    min_width: int = 1
    max_width: int = 100_000
    min_height: int = 1
    max_height: int = 100_000
    min_pixels: int = 1
    max_pixels: int = 100_000_000

    def bounds(self) -> tuple[int, int, int, int]:
        f = self.factor
        up, down = lambda v: max(f, -(-v // f) * f), lambda v: v // f * f
        out = up(self.min_width), down(self.max_width), up(self.min_height), down(self.max_height)
        if out[0] > out[1] or out[2] > out[3] or self.min_pixels > self.max_pixels:
            raise ValueError("no input size meets the bounds")
        return out


def fast_size(df: DataFrame, width: Column, height: Column, r: Resize, name: str = "size") -> DataFrame:
    """df with a struct (w, h) of the scaled and rounded input size, null where rounding left the pixel bounds.

    Steps are columns, so each is computed once.
    """
    lo_w, hi_w, lo_h, hi_h = r.bounds()
    f = float(r.factor)
    w, h, s, a, b = (F.col(f"_{c}") for c in "whsab")
    df = df.withColumns({"_w": width.cast("double"), "_h": height.cast("double")})
    df = df.withColumns({"_w": F.when(h < f, F.floor(w * f / h + 0.5).cast("double")).otherwise(w), "_h": F.greatest(h, F.lit(f))})
    df = df.withColumns({"_h": F.when(w < f, F.floor(h * f / w + 0.5).cast("double")).otherwise(h), "_w": F.greatest(w, F.lit(f))})
    df = df.withColumns({"_a": F.greatest(lo_w / w, lo_h / h, F.sqrt(r.min_pixels / (w * h))), "_b": F.least(hi_w / w, hi_h / h, F.sqrt(r.max_pixels / (w * h)))})
    df = df.withColumn("_s", F.greatest(F.least(a, b), F.least(F.lit(1.0), F.greatest(a, b))))

    def quantised(units: Column, low: int, high: int) -> Column:
        n = F.when(s < 1, F.floor(units + 1e-10)).when(s > 1, F.ceil(units - 1e-10)).otherwise(F.floor(units + 0.5))
        return F.greatest(F.lit(low), F.least(F.lit(high), F.greatest(F.lit(0), F.least(F.lit(100_000), n)) * r.factor)).cast("int")

    df = df.withColumns({"_a": w * s / f, "_b": h * s / f})
    df = df.withColumns({"_a": quantised(a, lo_w, hi_w), "_b": quantised(b, lo_h, hi_h)})
    fits = (a.cast("bigint") * b.cast("bigint")).between(r.min_pixels, r.max_pixels)
    return df.withColumn(name, F.when(fits, F.struct(a.alias("w"), b.alias("h")))).drop("_w", "_h", "_s", "_a", "_b")


def grid(r: Resize) -> np.ndarray:
    """All sizes of a setting: widths on the grid, each with its least and greatest feasible height."""
    lo_w, hi_w, lo_h, hi_h = r.bounds()
    f = r.factor
    w = np.arange(lo_w, hi_w + 1, f, dtype=np.int64)
    low = np.maximum(lo_h, -(-(-(-r.min_pixels // w)) // f) * f)
    high = np.minimum(hi_h, r.max_pixels // w // f * f)
    return np.stack([w, low, high], axis=1)[low <= high]


def grid_size(width: int, height: int, r: Resize, sizes: np.ndarray | None = None) -> tuple[int, int]:
    """The size on the grid of factors whose shape and area are closest; for the few that fast_size leaves."""
    sizes = grid(r) if sizes is None else sizes
    if not len(sizes):
        raise ValueError("no input size meets the bounds")
    w, low, high = sizes.T
    middle = np.clip(np.floor(w * height / width / r.factor + 0.5).astype(np.int64) * r.factor, low, high)
    h = np.stack([low, middle, high], axis=1)
    wanted = min(max(width * height, r.min_pixels), r.max_pixels)
    off = np.abs(np.log((w[:, None] / h) / (width / height))) + np.abs(np.log(w[:, None] * h / wanted))
    at = int(np.argmin(off))
    return int(w[at // 3]), int(h.ravel()[at])


def input_size(df: DataFrame, width: Column, height: Column, r: Resize, name: str = "size") -> DataFrame:
    """df with a struct (w, h): column functions, and an Arrow function for the rows that need the grid only."""

    @F.pandas_udf("w int, h int")
    def searched(ws: pd.Series, hs: pd.Series) -> pd.DataFrame:
        known: dict[tuple[int, int], tuple[int, int]] = {}
        rows, sizes = [], grid(r)
        for w, h in zip(ws, hs, strict=True):
            if pd.isna(w):
                rows.append((None, None))
                continue
            if (w, h) not in known:
                known[w, h] = grid_size(int(w), int(h), r, sizes)
            rows.append(known[w, h])
        return pd.DataFrame(rows, columns=["w", "h"])

    df = fast_size(df, width, height, r, name)
    missing = F.col(name).isNull()
    return df.withColumn(name, F.coalesce(name, searched(F.when(missing, width), F.when(missing, height))))


def window_sums(requests: DataFrame, widths: tuple[int, ...], group: tuple[str, ...] = ("model",)) -> DataFrame:
    """For each capture width, the prefill sum of every run of that many requests of neighbouring visual cost.

    Requests of a group are a bounded pending snapshot; groups share nothing, so groups run in parallel.
    """
    w = Window.partitionBy(*group).orderBy("visual", "ticket")
    placed = requests.withColumn("rank", F.row_number().over(w) - 1)
    n = F.count("*").over(Window.partitionBy(*group))
    parts = [placed.select(*group, F.lit(k).alias("width"), (F.col("rank") - (k - 1)).alias("start"), F.sum("prefill").over(w.rowsBetween(-(k - 1), 0)).alias("total"), n.alias("n")).where("start >= 0") for k in widths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def visual_buckets(requests: DataFrame, widths: tuple[int, ...], capacity: int, budget: int, group: tuple[str, ...] = ("model",)) -> DataFrame:
    """requests with rank, capture_size and bucket: the widest run that fits the budget is a bucket of its own, the rest chunks around it."""
    best = (
        window_sums(requests, widths, group).where((F.col("total") <= budget) & (F.col("width") <= F.least(F.lit(capacity), F.col("n"))))
        .groupBy(*group).agg(F.max(F.struct("width", "total", (-F.col("start")).alias("minus"))).alias("b"))
    )
    w = Window.partitionBy(*group).orderBy("visual", "ticket")
    placed = requests.withColumn("rank", F.row_number().over(w) - 1).join(best.select(*group, F.col("b.width").alias("capture_size"), (-F.col("b.minus")).alias("anchor")), list(group), "left")
    placed = placed.withColumn("capture_size", F.coalesce("capture_size", F.lit(1))).withColumn("anchor", F.coalesce("anchor", F.lit(0)))
    size, at, anchor = F.col("capture_size"), F.col("rank"), F.col("anchor")
    before = F.ceil(anchor / size)
    bucket = F.when(at < anchor, F.floor(at / size)).otherwise(before + F.floor((at - anchor) / size))
    return placed.withColumn("bucket", bucket.cast("bigint")).drop("anchor")


GREEDY = """
  aggregate(slots, named_struct('count', 0L, 'work', 0L, 'tickets', cast(array() as array<bigint>)),
    (a, r) -> IF({full} OR (a.count > 0 AND a.work + r.prefill > {budget}), a,
      named_struct('count', a.count + 1, 'work', a.work + r.prefill, 'tickets', array_append(a.tickets, r.ticket))))"""


def next_wave(requests: DataFrame, widths: tuple[int, ...], capacity: int, budget: int, now_ms: float, timeout_ms: float, max_bypasses: int = 4, free: int = 1 << 20, scan_limit: int = 256, group: tuple[str, ...] = ("model",)) -> DataFrame:
    """For each group the next wave of requests (ticket, visual, prefill, bypasses, queued_ms): bucket, aged, capture_size and tickets.

    The first scan_limit tickets are put in visual buckets. If the oldest has aged (bypassed often, or half its time waited),
    its bucket is next and it goes first; else the bucket is next of which most requests fit the budget one after the other,
    then of most work, then the first. The wave takes what fits, from the bucket in order of cost, then from the others in
    order of tickets, up to the capture size and the free slots; a request over the budget goes alone.
    """
    queue = Window.partitionBy(*group).orderBy("ticket")
    pending = requests.withColumn("_turn", F.row_number().over(queue)).where(F.col("_turn") <= scan_limit)
    late = (F.col("bypasses") >= max_bypasses) | (F.lit(now_ms) - F.col("queued_ms") >= timeout_ms / 2)
    pending = visual_buckets(pending.withColumn("_late", late & (F.col("_turn") == 1)), widths, capacity, budget, group)
    slot = F.struct("rank", "ticket", F.col("prefill").cast("bigint").alias("prefill"), "bucket", (F.col("_turn") == 1).alias("oldest"))
    # A group's snapshot has scan_limit requests at most, so one row holds it.
    snap = pending.groupBy(*group).agg(F.array_sort(F.collect_list(slot)).alias("all"), F.max("_late").alias("aged"), F.max("capture_size").cast("bigint").alias("capture_size"))
    snap = snap.withColumn("buckets", F.sequence(F.lit(0).cast("bigint"), F.array_max(F.transform("all", lambda r: r["bucket"]))))
    greedy = GREEDY.replace("slots", "filter(all, r -> r.bucket = b)").format(full="false", budget=budget)
    snap = snap.withColumn("fits", F.expr(f"transform(buckets, b -> {greedy})"))
    best = F.expr("array_max(transform(fits, (f, b) -> named_struct('count', f.count, 'work', f.work, 'first', -b)))")
    own = F.expr("filter(all, r -> r.oldest)[0].bucket")
    snap = snap.withColumn("bucket", F.when(F.col("aged"), own).otherwise(-best["first"]).cast("bigint"))
    line = F.expr("""
      concat(IF(aged, filter(all, r -> r.oldest), array()), filter(all, r -> r.bucket = bucket AND NOT (aged AND r.oldest)),
        array_sort(filter(all, r -> r.bucket <> bucket AND NOT (aged AND r.oldest)), (x, y) -> IF(x.ticket < y.ticket, -1, 1)))""")
    snap = snap.withColumn("slots", line).withColumn("_target", F.least(F.lit(free).cast("bigint"), "capture_size"))
    wave = F.expr(GREEDY.format(full="a.count >= _target", budget=budget))["tickets"]
    return snap.select(*group, "bucket", "aged", "capture_size", wave.alias("tickets"))


ADMITTED = "job bigint, decision string, reason string"
REFUSED = {"jobs": ("503", "cumulative job limit"), "active": ("429", "active job limit"), "bytes": ("429", "upload byte limit")}


def admission(log: DataFrame, max_jobs: int, max_active: int, max_upload_bytes: int, shard: str = "server") -> DataFrame:
    """Replay of an arrival log (shard, job, arrival_ms, upload_ms, service_ms, bytes): each job accepted (202) or refused with a reason.

    A job holds a place from its arrival on, and its bytes while it is uploaded; then it is admitted for good and active until
    its service ends. Refusals, in this order: 503 where places and admitted jobs reach max_jobs; 429 where places and active
    jobs reach max_active; 429 where the uploads' bytes would pass max_upload_bytes. Each server's log is replayed by itself.
    """

    def replay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        uploads: list[tuple[float, float, int]] = []  # end of upload, end of service, bytes
        active: list[float] = []
        admitted, held, out = 0, 0, []
        for job, at, upload, service, size in rows.sort_values(["arrival_ms", "job"])[["job", "arrival_ms", "upload_ms", "service_ms", "bytes"]].itertuples(index=False):
            while uploads and uploads[0][0] <= at:
                _, end, freed = heapq.heappop(uploads)
                admitted, held = admitted + 1, held - freed
                heapq.heappush(active, end)
            while active and active[0] <= at:
                heapq.heappop(active)
            tests = {"jobs": admitted + len(uploads) >= max_jobs, "active": len(active) + len(uploads) >= max_active, "bytes": held + size > max_upload_bytes}
            refusal = next((REFUSED[k] for k, hit in tests.items() if hit), None)
            if refusal is None:
                heapq.heappush(uploads, (at + upload, at + upload + service, size))
                held += size
            out.append((job, *(refusal or ("202", None))))
        return pd.DataFrame(out, columns=["job", "decision", "reason"])

    return log.groupBy(shard).applyInPandas(replay, ADMITTED)


POOLED = "request bigint, started_ms double, outcome string"


def recognition_pool(log: DataFrame, workers: int = 128, max_requests: int = 256, max_bytes: int = 1 << 28, timeout_ms: float = 600_000.0, group: str = "server") -> DataFrame:
    """Replay of a bounded pool (server, request, arrival_ms, service_ms, bytes), each server by itself.

    A request waits, first come first served, until count and bytes in the pool leave room; `oversize` never fits, `timeout`
    waited too long, `done` ran from started_ms on the first free worker. Credits come back when a request ends.
    """

    def replay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        inside: list[tuple[float, int]] = []  # ends and bytes of admitted requests
        free, held, now, out = [0.0] * workers, 0, 0.0, []
        for r in rows.sort_values(["arrival_ms", "request"]).itertuples(index=False):
            if r.bytes > max_bytes:
                out.append((r.request, None, "oversize"))
                continue
            at = now = max(now, r.arrival_ms)
            while inside and (inside[0][0] <= at or len(inside) >= max_requests or held + r.bytes > max_bytes):
                end, size = heapq.heappop(inside)
                held, at = held - size, max(at, end)
            if at - r.arrival_ms > timeout_ms:
                out.append((r.request, None, "timeout"))
                continue
            now = at
            start = max(at, heapq.heappop(free))
            heapq.heappush(free, start + r.service_ms)
            heapq.heappush(inside, (start + r.service_ms, r.bytes))
            held += r.bytes
            out.append((r.request, start, "done"))
        return pd.DataFrame(out, columns=["request", "started_ms", "outcome"])

    return log.groupBy(group).applyInPandas(replay, POOLED)


def best_static_bucket(requests: DataFrame, bounds: tuple[int, ...], group: tuple[str, ...] = ("model",)) -> DataFrame:
    """For each group the static bucket of most requests, then of most work, then the lowest."""
    t = requests.withColumn("bucket", static_bucket(F.col("visual"), bounds)).groupBy(*group, "bucket").agg(F.count("*").alias("count"), F.sum("prefill").alias("work"))
    return t.groupBy(*group).agg(F.max(F.struct("count", "work", (-F.col("bucket")).alias("minus"))).alias("b")).select(*group, (-F.col("b.minus")).cast("bigint").alias("bucket"), F.col("b.count").alias("count"))


@dataclass
class Sample:
    """What a control window has seen."""

    began: float = 0.0
    done: int = 0
    failed: int = 0
    waiting: int = 0
    blocked: int = 0
    work: float = 0.0


@dataclass
class Controller:
    """An adaptive budget of tokens in flight that learns from windows of finished work.

    A window closes after window_ms and min_samples requests. There is demand if min_samples of them ended while others
    waited, and as many while the budget kept the next one back. A changed budget opens an epoch: requests that started before
    it don't count, and its window begins when the last of them has ended. A window after a change is compared with the one
    before: a gain goes on growing (doubling at first, then by step), a loss backs off, a flat one returns. At the ceiling the
    budget is tried downwards. Overload, or a fifth of failures, backs off at once; growth then waits for cooldown_ms.
    """

    budget: int = 8_192
    least: int = 1_024
    most: int = 32_768
    window_ms: float = 5_000
    min_samples: int = 8
    cooldown_ms: float = 3_000
    slow_gain: float = 0.10
    probe_gain: float = 0.03
    step: float = 0.10
    backoff: float = 0.85
    state: str = "slow_start"
    epoch: int = 0
    stale: int = 0
    comparing: bool = False
    overloaded: bool = False
    rate: float = 0.0
    compared: int = 0
    quiet_until: float = 0.0
    seen: Sample = field(default_factory=Sample)

    def up(self, factor: float) -> int:
        return min(self.most, max(self.budget + 1, math.ceil(self.budget * factor)))

    def down(self, factor: float) -> int:
        return max(self.least, int(self.budget * factor))

    def change(self, budget: int, at: float, inflight: int) -> None:
        self.budget = min(self.most, max(self.least, budget))
        self.epoch, self.stale, self.seen = self.epoch + 1, inflight, Sample(at)

    def hold(self, at: float | None = None) -> None:
        self.state = "hold"
        if at is not None:
            self.quiet_until = at + self.cooldown_ms

    def observe(self, at: float, work: float = 0.0, failed: bool = False, overload: bool = False, epoch: int | None = None, inflight: int = 0, waiting: bool = True, blocked: bool = True) -> None:
        """One finished request: the epoch it started in, and what is in flight and waits after it."""
        epoch = self.epoch if epoch is None else epoch
        if epoch != self.epoch and self.stale:
            self.stale -= 1
            if not self.stale:
                self.seen = Sample(at)
        if overload:
            self.overloaded, self.comparing = True, False
            if (smaller := self.down(self.backoff)) < self.budget:
                self.change(smaller, at, inflight)
            self.hold(at)
        if epoch != self.epoch or self.stale:
            return
        s = self.seen
        s.done, s.failed, s.work = s.done + 1, s.failed + failed, s.work + (0.0 if failed else work)
        s.waiting, s.blocked = s.waiting + waiting, s.blocked + blocked
        if at - s.began >= self.window_ms and s.done >= self.min_samples:
            self.decide(at, inflight)

    def decide(self, at: float, inflight: int) -> None:
        s = self.seen
        rate = 1000 * s.work / (at - s.began) if at > s.began else 0.0
        pressed = s.waiting >= self.min_samples
        demand = pressed and s.blocked >= self.min_samples
        wanted = self.budget
        if self.overloaded:
            pass
        elif 5 * s.failed >= s.done:
            wanted, self.comparing = self.down(self.backoff), False
            self.hold(at)
        elif self.comparing and self.rate > 0:
            gain = rate / self.rate - 1
            wanted = self.tried_less(gain, demand, at) if self.budget < self.compared else self.tried_more(gain, demand, at)
        elif at >= self.quiet_until and demand and self.budget < self.most:
            wanted = self.up(2.0 if self.state == "slow_start" else 1 + self.step)
            self.state = self.state if self.state == "slow_start" else "probe"
        elif at >= self.quiet_until and pressed and self.budget == self.most and self.rate > 0:
            wanted, self.state = self.down(1 - self.step), "probe"
        self.rate, self.compared = rate, self.budget
        if wanted != self.budget:
            self.change(wanted, at, inflight)
            self.comparing = self.state != "hold"
        else:
            self.comparing, self.seen = False, Sample(at)
        self.overloaded = False

    def tried_more(self, gain: float, demand: bool, at: float) -> int:
        if self.state == "slow_start" and gain >= self.slow_gain and demand:
            return self.up(2.0)
        self.state = "probe" if self.state == "slow_start" else self.state
        if gain >= self.probe_gain and demand:
            return self.up(1 + self.step)
        back = self.down(self.backoff) if gain < -self.probe_gain else max(self.least, self.compared)
        self.hold(at)
        return back

    def tried_less(self, gain: float, demand: bool, at: float) -> int:
        if gain > self.probe_gain and demand:
            lower = self.down(1 - self.step)
            if lower == self.budget:
                self.quiet_until = at + self.cooldown_ms
            return lower
        wanted = self.compared if gain < -self.probe_gain else self.budget
        self.hold(at)
        return wanted


REPLAYED = "model string, ticket bigint, state string, budget bigint"


def replay_controller(log: DataFrame, **settings) -> DataFrame:
    """Replay of finished requests (model, ticket, started_ms, at_ms, work, failed, overload, waiting, blocked): state and budget after each.

    A model's log is replayed in order of time in one task.
    """

    def replay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at_ms", "ticket"])
        c, out, changes = Controller(**settings), [], []
        c.seen.began = float(rows["started_ms"].min())
        starts = np.sort(rows["started_ms"].to_numpy(float))
        for n, r in enumerate(rows.itertuples(index=False), 1):
            inflight = int(np.searchsorted(starts, r.at_ms, side="right")) - n
            before = c.epoch
            c.observe(r.at_ms, r.work, r.failed, r.overload, bisect.bisect_right(changes, r.started_ms), max(0, inflight), r.waiting, r.blocked)
            changes += [r.at_ms] * (c.epoch - before)
            out.append((key[0], r.ticket, c.state, c.budget))
        return pd.DataFrame(out, columns=["model", "ticket", "state", "budget"])

    return log.groupBy("model").applyInPandas(replay, REPLAYED)


def ewma_scale(ratios: Column, start: float = 1.0) -> Column:
    """Token scale after an ordered array of actual / estimated tokens."""
    return F.aggregate(ratios, F.lit(start), lambda s, r: 0.8 * s + 0.2 * F.greatest(F.lit(0.5), F.least(F.lit(4.0), r * s)))


def head_of_line(rows: Iterator[tuple[int, int]], free: int, max_bypasses: int = 4) -> list[int]:
    """Tickets admitted from (ticket, tokens) in order under a free budget; a blocked head is bypassed at most max_bypasses times."""
    waiting, bypasses, admitted = None, 0, []
    for ticket, tokens in rows:
        if tokens <= free and (waiting is None or bypasses < max_bypasses):
            bypasses += waiting is not None
            free -= tokens
            admitted.append(ticket)
        elif waiting is None:
            waiting = ticket
    return admitted
