"""Queries over requests, their costs and buckets, jobs and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import jobs as J
from pagemill.operators import scheduling as S
from pagemill.sources.views import COMPLETIONS_SQL, JOBS_SQL, LAYOUT_BOXES_SQL, REQUESTS_SQL, completions, jobs, layout_boxes, requests, table

SIZE = S.Resize(factor=28, max_width=448, max_height=448, min_pixels=28 * 28 * 4, max_pixels=100_000)
WIDTHS, CAPACITY, BUDGET, SCAN = (1, 2, 4, 8), 8, 600, 40
MOST_JOBS, MOST_ACTIVE, MOST_BYTES = 400, 8, 400_000
BOUNDS = (16, 32, 64)


def _dims(t: DataFrame) -> tuple[F.Column, F.Column]:
    return (F.col("x1") - F.col("x0")).cast("int"), (F.col("y1") - F.col("y0")).cast("int")


def input_size(spark: SparkSession, d: str) -> DataFrame:
    t = layout_boxes(spark, d)
    w, h = _dims(t)
    return S.fast_size(t, w, h, SIZE).select("doc_id", "source_index", "size.w", "size.h")


def input_size_grid(spark: SparkSession, d: str) -> DataFrame:
    t = layout_boxes(spark, d)
    w, h = _dims(t)
    return S.input_size(t, w * 3, h, SIZE).select("doc_id", "source_index", "size.w", "size.h")


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 900 + 20).cast("int").alias("w"), (F.col("doc_id") % 700 + 30).cast("int").alias("h"))
    visual = S.visual_cost(F.col("w"), F.col("h"), 4, 784, 600)
    return t.select("doc_id", S.token_estimate(F.col("w"), F.col("h"), F.col("text"), scale=1.25).alias("estimate"), visual.alias("visual"), S.prefill(visual, F.col("text")).alias("prefill"), S.static_bucket(visual, BOUNDS).cast("bigint").alias("bucket"))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    """Requests waiting for each user's slot."""
    return requests(spark, d).withColumn("model", F.col("user_id"))


def visual_windows(spark: SparkSession, d: str) -> DataFrame:
    t = S.window_sums(_pending(spark, d), (2, 4))
    return t.select(F.col("model").alias("user_id"), F.col("width").cast("bigint").alias("width"), F.col("start").cast("bigint").alias("start"), "total")


def visual_buckets(spark: SparkSession, d: str) -> DataFrame:
    t = S.visual_buckets(_pending(spark, d), WIDTHS, CAPACITY, BUDGET)
    return t.select("ticket", F.col("model").alias("user_id"), F.col("capture_size").cast("bigint").alias("capture_size"), "bucket")


def next_wave(spark: SparkSession, d: str) -> DataFrame:
    t = _pending(spark, d).withColumns({"bypasses": (F.col("ticket") % 5).cast("int"), "queued_ms": F.lit(0.0)})
    t = S.next_wave(t, WIDTHS, CAPACITY, BUDGET, 1.0, 10.0, free=6, scan_limit=SCAN)
    return t.select(F.col("model").alias("user_id"), "bucket", "aged", "capture_size", F.array_join(F.transform("tickets", lambda x: x.cast("string")), ",").alias("tickets"))


def static_bucket(spark: SparkSession, d: str) -> DataFrame:
    return S.best_static_bucket(_pending(spark, d), BOUNDS).select(F.col("model").alias("user_id"), "bucket", "count")


def priority_order(spark: SparkSession, d: str) -> DataFrame:
    return J.by_priority(jobs(spark, d)).select("sequence", "priority", F.col("turn").cast("bigint").alias("turn"))


def job_list(spark: SparkSession, d: str) -> DataFrame:
    return J.listing(jobs(spark, d), "queued", 20, 50).select("sequence", "priority", "state", "upload_bytes")


def job_total(spark: SparkSession, d: str) -> DataFrame:
    return J.listing_total(jobs(spark, d), "queued")


def job_delete(spark: SparkSession, d: str) -> DataFrame:
    """What a request to delete every third job answers, by state."""
    t = jobs(spark, d).withColumn("code", J.deletion_code(F.col("sequence") % 3 == 0))
    return t.groupBy("state", "code").agg(F.count("*").alias("n"))


def page_credits(spark: SparkSession, d: str) -> DataFrame:
    """Pages as large as their order's price: those that no byte budget can hold fail."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.floor("o_totalprice") * 3).cast("bigint").alias("bytes"))
    return t.select("doc_id", J.page_credit_error(F.col("bytes"), 600_000).alias("error"))


def job_states(spark: SparkSession, d: str) -> DataFrame:
    return J.state_counts(jobs(spark, d))


def job_cancel(spark: SparkSession, d: str) -> DataFrame:
    t = J.cancelled(jobs(spark, d), F.col("sequence") % 10 == 0)
    return t.groupBy("state", "code").agg(F.count("*").alias("n"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return J.model_metrics(completions(spark, d))


def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    return J.failure_counts(completions(spark, d))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return J.histogram(requests(spark, d), F.col("visual") * F.col("visual"), "model")


def peak_inflight(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select(F.col("event_type").alias("model"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.coalesce("value", F.lit(0.0)) * 60_000_000)).alias("end"), (F.col("user_id") + 1).alias("weight"))
    return J.peaks(t.where("end > start"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return J.latencies(completions(spark, d), "model")


def throughput(spark: SparkSession, d: str) -> DataFrame:
    return J.throughput(completions(spark, d)).select("successful", "seconds", F.round("per_second", 9).alias("per_second"))


def token_scale(spark: SparkSession, d: str) -> DataFrame:
    """The moving token scale of each user's requests in order."""
    t = requests(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ticket", (F.col("visual") / 40.0).alias("r")))).alias("rows"))
    return t.select("user_id", F.round(S.ewma_scale(F.transform("rows", lambda r: r["r"])), 9).alias("scale"))


def admission_replay(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select((F.col("user_id") % 16).alias("server"), F.col("event_id").alias("job"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("arrival_ms"), (F.col("event_id") % 50 * 1000.0).alias("upload_ms"), (F.coalesce("value", F.lit(0.0)) * 60_000).alias("service_ms"), (F.col("user_id") * 1000).alias("bytes"))
    return S.admission(t, MOST_JOBS, MOST_ACTIVE, MOST_BYTES)


def controller_replay(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0
    overload = F.coalesce(F.col("failed") & F.col("kind").isin("http_429", "http_503"), F.lit(False))
    t = completions(spark, d).select("model", "ticket", (at - F.col("latency_ms") * 1000).alias("started_ms"), at.alias("at_ms"), F.col("work").cast("double").alias("work"), "failed", overload.alias("overload"), (F.col("ticket") % 4 != 0).alias("waiting"), (F.col("ticket") % 3 != 0).alias("blocked"))
    return S.replay_controller(t, window_ms=600_000.0, cooldown_ms=60_000.0)


QUERIES = {
    "q_input_size": input_size, "q_input_size_grid": input_size_grid, "q_token_cost": token_cost, "q_visual_windows": visual_windows, "q_visual_buckets": visual_buckets, "q_next_wave": next_wave, "q_static_bucket": static_bucket,
    "q_priority_order": priority_order, "q_job_list": job_list, "q_job_total": job_total, "q_job_delete": job_delete, "q_page_credits": page_credits, "q_job_states": job_states, "q_job_cancel": job_cancel, "q_metrics": metrics, "q_failure_counts": failure_counts,
    "q_histogram": histogram, "q_peak_inflight": peak_inflight, "q_latency_percentiles": latency_percentiles, "q_throughput": throughput, "q_token_scale": token_scale,
    "q_admission_replay": admission_replay, "q_controller_replay": controller_replay,
}

_BUCKETS = f"""
r as (select *, row_number() over (partition by user_id order by visual, ticket) - 1 as rank, count(*) over (partition by user_id) as n from requests),
s as (
  select user_id, k as width, rank - (k - 1) as start, n, sum(prefill) over (partition by user_id, k order by rank rows between unbounded preceding and current row) as upto
  from r, unnest({list(WIDTHS)}) as t(k)),
runs as (select user_id, width, start, n, upto - coalesce(lag(upto, width) over (partition by user_id, width order by start), 0) as total from s),
best as (select user_id, arg_max((width, start), (width, total, -start)) as b from runs where start >= 0 and total <= {BUDGET} and width <= least({CAPACITY}, n) group by user_id),
bucketed as (
  select r.*, coalesce(b[1], 1) as size, coalesce(b[2], 0) as anchor,
    case when rank < coalesce(b[2], 0) then rank // coalesce(b[1], 1) else cast(ceil(coalesce(b[2], 0) / coalesce(b[1], 1)) as bigint) + (rank - coalesce(b[2], 0)) // coalesce(b[1], 1) end as bucket
  from r left join best using (user_id))"""
_FAST = """
d as (select doc_id, source_index, cast(x1 - x0 as int) as w, cast(y1 - y0 as int) as h from boxes),
a as (select *, case when h < 28 then floor(w * 28e0 / h + 0.5e0) else cast(w as double) end as w1, case when h < 28 then 28e0 else cast(h as double) end as h1 from d),
b as (select *, case when w1 < 28 then floor(h1 * 28e0 / w1 + 0.5e0) else h1 end as h2, case when w1 < 28 then 28e0 else w1 end as w2 from a),
c as (select *, greatest(28 / w2, 28 / h2, sqrt(3136 / (w2 * h2))) as lo, least(448 / w2, 448 / h2, sqrt(100000 / (w2 * h2))) as hi from b),
e as (select *, greatest(least(lo, hi), least(1e0, greatest(lo, hi))) as s from c),
f as (
  select *, greatest(28, least(448, 28 * case when s < 1 then floor(w2 * s / 28 + 1e-10) when s > 1 then ceil(w2 * s / 28 - 1e-10) else floor(w2 * s / 28 + 0.5e0) end)) as qw,
    greatest(28, least(448, 28 * case when s < 1 then floor(h2 * s / 28 + 1e-10) when s > 1 then ceil(h2 * s / 28 - 1e-10) else floor(h2 * s / 28 + 0.5e0) end)) as qh from e)"""

SQL = {
    "q_input_size": f"with {LAYOUT_BOXES_SQL}, {_FAST} select doc_id, source_index, cast(case when qw * qh between 3136 and 100000 then qw end as int) as w, cast(case when qw * qh between 3136 and 100000 then qh end as int) as h from f",
    "q_token_cost": """
with t as (select doc_id, strlen(coalesce(text, '')) as n, doc_id % 900 + 20 as w, doc_id % 700 + 30 as h from documents),
v as (select *, least(600, 4 + (w * h + 783) // 784) as visual from t)
select doc_id, cast(ceil((64 + (n + 3) // 4 + 512 + (w * h + 783) // 784) * 1.25e0) as bigint) as estimate, cast(visual as bigint) as visual, cast(64 + (n + 3) // 4 + visual as bigint) as prefill,
  cast((visual >= 16)::int + (visual >= 32)::int + (visual >= 64)::int as bigint) as bucket from v""",
    "q_visual_windows": f"""with {REQUESTS_SQL},
r as (select *, row_number() over (partition by user_id order by visual, ticket) - 1 as rank from requests)
select user_id, cast(2 as bigint) as width, rank - 1 as start, cast(prefill + lag(prefill) over w as bigint) as total from r window w as (partition by user_id order by rank) qualify rank >= 1
union all select user_id, cast(4 as bigint), rank - 3, cast(prefill + lag(prefill) over w + lag(prefill, 2) over w + lag(prefill, 3) over w as bigint) from r window w as (partition by user_id order by rank) qualify rank >= 3""",
    "q_visual_buckets": f"with {REQUESTS_SQL}, {_BUCKETS} select ticket, user_id, cast(size as bigint) as capture_size, cast(bucket as bigint) as bucket from bucketed",
    "q_next_wave": f"""with {REQUESTS_SQL.replace('requests as', 'every as', 1)},
requests as (select * from every qualify row_number() over (partition by user_id order by ticket) <= {SCAN}), {_BUCKETS},
o as (select user_id, min(ticket) as oldest, min(ticket) % 5 >= 4 as aged, arg_min(bucket, ticket) as own, max(size) as size from bucketed group by user_id),
g as (
  select user_id, bucket, list_reduce(list_prepend({{'c': 0::bigint, 'w': 0::bigint, 'p': 0::bigint}}, list({{'c': 0::bigint, 'w': 0::bigint, 'p': prefill::bigint}} order by rank)),
    lambda a, x: case when a.c > 0 and a.w + x.p > {BUDGET} then a else {{'c': a.c + 1, 'w': a.w + x.p, 'p': 0::bigint}} end) as f from bucketed group by user_id, bucket),
m as (select user_id, arg_max(bucket, (f.c, f.w, -bucket)) as fullest from g group by user_id),
pick as (select *, case when aged then own else fullest end as chosen, least(6, size)::bigint as target from o join m using (user_id)),
line as (
  select user_id, list({{'c': 0::bigint, 'w': 0::bigint, 'p': prefill::bigint, 't': [ticket]}}
    order by case when aged and ticket = oldest then 0 when bucket = chosen then 1 else 2 end, case when bucket = chosen then rank else ticket end) as l
  from bucketed join pick using (user_id) group by user_id),
wave as (
  select user_id, list_reduce(list_prepend({{'c': 0::bigint, 'w': 0::bigint, 'p': 0::bigint, 't': []::bigint[]}}, l),
    lambda a, x: case when a.c >= target or (a.c > 0 and a.w + x.p > {BUDGET}) then a else {{'c': a.c + 1, 'w': a.w + x.p, 'p': 0::bigint, 't': list_concat(a.t, x.t)}} end) as f
  from line join pick using (user_id))
select user_id, cast(chosen as bigint) as bucket, aged, cast(size as bigint) as capture_size, array_to_string(f.t, ',') as tickets from pick join wave using (user_id)""",
    "q_static_bucket": f"""with {REQUESTS_SQL},
g as (select user_id, (visual >= 16)::int + (visual >= 32)::int + (visual >= 64)::int as bucket, count(*) as n, sum(prefill) as work from requests group by all)
select user_id, cast(arg_max(bucket, (n, work, -bucket)) as bigint) as bucket, max(n) as count from g group by user_id""",
    "q_priority_order": f"with {JOBS_SQL} select sequence, priority, row_number() over (order by priority desc, sequence) as turn from jobs",
    "q_job_list": f"with {JOBS_SQL} select sequence, priority, state, upload_bytes from jobs where state = 'queued' order by sequence limit 50 offset 20",
    "q_job_states": f"""with {JOBS_SQL}
select count(*) as admitted, count(*) filter (state = 'queued') as queued, cast(0 as bigint) as reading, cast(0 as bigint) as processing, cast(0 as bigint) as finalizing, count(*) filter (state = 'succeeded') as succeeded,
  count(*) filter (state = 'failed') as failed, cast(0 as bigint) as cancelling, cast(0 as bigint) as cancelled, cast(sum(upload_bytes) as bigint) as upload_bytes, count(*) filter (state = 'queued') as active, true as conserved from jobs""",
    "q_job_cancel": f"""with {JOBS_SQL},
c as (select case when sequence % 10 = 0 and state = 'queued' then 'cancelled' else state end as state, cast(case when sequence % 10 = 0 then case when state = 'queued' then 200 else 409 end end as int) as code from jobs)
select state, code, count(*) as n from c group by all""",
    "q_metrics": f"""with {COMPLETIONS_SQL}
select model, count(*) as completed, count(*) filter (failed) as failed_requests, count(*) filter (not failed) as successful, count(*) filter (failed and kind in ('http_429', 'http_503')) as overload,
  round(sum(queue_ms), 4) as queue_ms, cast(coalesce(sum(work) filter (not failed), 0) as bigint) as work, round(sum(latency_ms), 4) as latency_ms, max(latency_ms) as max_latency_ms, cast(coalesce(sum(total_tokens - output_tokens) filter (not failed and total_tokens > 0 and total_tokens >= output_tokens), 0) as bigint) as prompt_tokens,
  cast(coalesce(sum(output_tokens) filter (not failed), 0) as bigint) as output_tokens from done group by model""",
    "q_failure_counts": f"with {COMPLETIONS_SQL} select model, kind, count(*) as n from done where failed group by all",
    "q_histogram": f"with {REQUESTS_SQL} select model, cast(least(1048576, pow(2, ceil(log2(cast(visual * visual as double)) - 1e-12))) as bigint) as bin, count(*) as n from requests group by all",
    "q_peak_inflight": """
with t as (select event_type as model, epoch_us(ts) as a, epoch_us(ts) + cast(floor(coalesce(value, 0e0) * 60000000) as bigint) as b, user_id + 1 as w from events),
e as (select model, a as m, 1 as n, w from t where b > a union all select model, b, -1, -w from t where b > a),
s as (select model, sum(n) over (partition by model order by m, n) as r, sum(w) over (partition by model order by m, n) as x from e)
select model, cast(max(r) as bigint) as peak_requests, cast(max(x) as bigint) as peak_weight from s group by model""",
    "q_latency_percentiles": f"with {COMPLETIONS_SQL} select model, count(*) as n, quantile_disc(latency_ms, 0.5) as p50, quantile_disc(latency_ms, 0.95) as p95, quantile_disc(latency_ms, 0.99) as p99 from done where not failed group by model",
    "q_throughput": f"with {COMPLETIONS_SQL}, t as (select count(*) filter (not failed) as successful, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds from done) select successful, seconds, round(successful / seconds, 9) as per_second from t",
    "q_token_scale": f"""with recursive {REQUESTS_SQL},
r as (select user_id, visual / 40e0 as x, row_number() over (partition by user_id order by ticket) as k from requests),
f(user_id, k, s) as (select distinct user_id, cast(0 as bigint), 1e0 from r union all select f.user_id, r.k, 0.8e0 * s + 0.2e0 * greatest(0.5e0, least(4e0, x * s)) from f join r on r.user_id = f.user_id and r.k = f.k + 1)
select user_id, round(arg_max(s, k), 9) as scale from f group by user_id""",
    "q_job_total": f"with {JOBS_SQL} select count(*) as total from jobs where state = 'queued'",
    "q_job_delete": f"""with {JOBS_SQL}
select state, cast(case when sequence % 3 = 0 then case when state in ('succeeded', 'failed', 'cancelled') then 204 else 409 end end as int) as code, count(*) as n from jobs group by all""",
    "q_page_credits": "select o_orderkey as doc_id, case when cast(floor(o_totalprice) as bigint) * 3 > 600000 then 'page exceeds the byte limit of ready pages' end as error from orders",
    "q_input_size_grid": f"""with {LAYOUT_BOXES_SQL}, {_FAST.replace('cast(x1 - x0 as int) as w', 'cast(x1 - x0 as int) * 3 as w')},
s as (select gw, greatest(28, ((3136 + gw - 1) // gw + 27) // 28 * 28) as low, least(448, 100000 // gw // 28 * 28) as high from unnest(range(28, 449, 28)) as t(gw)),
x as (select * from f, s where not qw * qh between 3136 and 100000 and low <= high),
y as (select *, unnest([low, least(high, greatest(low, cast(floor(cast(gw * h as double) / w / 28 + 0.5e0) as bigint) * 28)), high]) as gh, unnest([0, 1, 2]) as k from x),
z as (select doc_id, source_index, gw, gh, k, abs(ln((gw / cast(gh as double)) / (w / cast(h as double)))) + abs(ln(gw * gh / cast(least(100000, greatest(3136, w * h)) as double))) as off from y),
near as (select doc_id, source_index, arg_min((gw, gh), (off, gw, k)) as size from z group by all)
select doc_id, source_index, cast(case when qw * qh between 3136 and 100000 then qw else size[1] end as int) as w, cast(case when qw * qh between 3136 and 100000 then qh else size[2] end as int) as h from f left join near using (doc_id, source_index)""",
    "q_admission_replay": f"""with recursive t as (
  select user_id % 16 as server, event_id as job, epoch_us(ts) / 1000e0 as tm, event_id % 50 * 1000e0 as upload, coalesce(value, 0e0) * 60000 as service, user_id * 1000 as bytes,
    row_number() over (partition by user_id % 16 order by epoch_us(ts) / 1000e0, event_id) as k from events),
r(server, k, ups, act, admitted, job, decision, reason) as (
  select distinct server, 0::bigint, []::struct(e double, f double, b bigint)[], []::double[], 0::bigint, null::bigint, null::varchar, null::varchar from t
  union all
  select server, k, case when reason is null then list_append(ups, {{'e': tm + upload, 'f': tm + upload + service, 'b': bytes::bigint}}) else ups end, act, admitted, job,
    case reason when 'cumulative job limit' then '503' when 'active job limit' then '429' when 'upload byte limit' then '429' else '202' end, reason
  from (
    select *, case when admitted + len(ups) >= {MOST_JOBS} then 'cumulative job limit' when len(act) + len(ups) >= {MOST_ACTIVE} then 'active job limit'
      when bytes + coalesce(list_sum(list_transform(ups, lambda x: x.b)), 0) > {MOST_BYTES} then 'upload byte limit' end as reason
    from (
      select t.server, t.k, t.tm, t.upload, t.service, t.bytes, t.job, list_filter(r.ups, lambda x: x.e > t.tm) as ups,
        list_filter(list_concat(r.act, list_transform(list_filter(r.ups, lambda x: x.e <= t.tm), lambda x: x.f)), lambda f: f > t.tm) as act,
        r.admitted + len(list_filter(r.ups, lambda x: x.e <= t.tm)) as admitted
      from r join t on t.server = r.server and t.k = r.k + 1)))
select job, decision, reason from r where k > 0""",
}
