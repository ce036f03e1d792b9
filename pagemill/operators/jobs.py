"""Job tables: order, listing, state changes and metrics, as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import file_extension, under_root
from pagemill.sources.files import EXTENSIONS

STATES = ("queued", "reading", "processing", "finalizing", "succeeded", "failed", "cancelling", "cancelled")
TERMINAL = ("succeeded", "failed", "cancelled")


#: Sequence numbers in one cell of the global order.
CELL = 1 << 16


def by_priority(jobs: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """jobs with turn: higher priority first, then first come, in each group or over all jobs.

    A global turn is a row number inside cells of (priority, sequence range) plus the sizes of the cells before, so no task
    holds all jobs.
    """
    if group:
        return jobs.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("priority"), "sequence")))
    placed = jobs.withColumn("cell", F.floor(F.col("sequence") / CELL))
    sizes = placed.groupBy(F.col("priority").alias("p"), F.col("cell").alias("c")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("p"), "c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a cell
    placed = placed.join(sizes.select("p", "c", before.alias("before")), F.col("priority").eqNullSafe(F.col("p")) & (F.col("cell") == F.col("c")))
    inside = F.row_number().over(Window.partitionBy("priority", "cell").orderBy("sequence"))
    return placed.withColumn("turn", F.col("before") + inside).drop("cell", "p", "c", "before")


def submitted(arrivals: DataFrame, root: str, first: int = 0) -> DataFrame:
    """Arrivals (arrival, path, priority) as queued jobs, or with the reason why they are refused. sequence: from first, by arrival."""
    bad = (
        F.when(~F.coalesce(under_root(F.col("path"), F.lit(root)), F.lit(False)), "path outside the allowed root")
        .when(~file_extension(F.col("path")).isin(*EXTENSIONS), "unsupported extension")
        .when(F.abs(F.coalesce("priority", F.lit(0))) > 1_000_000, "priority out of range")
    )
    good = F.col("error").isNull()
    out = arrivals.withColumn("error", bad).withColumn("job_id", new_job_id()).withColumn("state", F.when(good, "queued").otherwise("failed"))
    return out.withColumn("sequence", F.col("arrival") + first)


def listing(jobs: DataFrame, state: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of jobs in order of sequence."""
    if state is not None and state not in STATES:
        raise ValueError("unknown state")
    if not 0 <= offset <= 1_000_000 or not 1 <= limit <= 200:
        raise ValueError("offset or limit out of range")
    some = jobs if state is None else jobs.where(F.col("state") == state)
    return some.orderBy("sequence").offset(offset).limit(limit)


def listing_total(jobs: DataFrame, state: str | None = None) -> DataFrame:
    """One row: how many jobs the pages of listing() have together."""
    return (jobs if state is None else jobs.where(F.col("state") == state)).agg(F.count("*").alias("total"))


def state_counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs by state, active ones, and whether admitted = succeeded + failed + cancelled + active."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    out = jobs.agg(F.count("*").alias("admitted"), *counts, F.coalesce(F.sum("upload_bytes"), F.lit(0)).cast("bigint").alias("upload_bytes"))
    active = F.col("admitted") - sum((F.col(s) for s in TERMINAL), F.lit(0))
    live = sum((F.col(s) for s in STATES if s not in TERMINAL), F.lit(0))
    return out.withColumn("active", active).withColumn("conserved", active == live)


def next_state(state: Column, reader_done: Column, outstanding: Column, pages: Column, failed: Column) -> Column:
    """State of a job after its counters changed; a finished job stays as it is."""
    return (
        F.when(state.isin(*TERMINAL), state)
        .when((state == "cancelling") & reader_done & (outstanding == 0), "cancelled").when(state == "cancelling", state)
        .when(failed, "failed")
        .when(reader_done & (outstanding == 0) & (pages == 0), "failed").when(reader_done & (outstanding == 0), "finalizing")
        .when(pages > 0, "processing").otherwise("reading")
    )


def cancelled(jobs: DataFrame, which: Column) -> DataFrame:
    """jobs after a cancel request for which, with code: 200 done, 202 stopping, 409 finished before, null untouched."""
    s = F.col("state")
    code = F.when(which, F.when(s == "cancelled", 200).when(s.isin("succeeded", "failed"), 409).when(s == "queued", 200).otherwise(202))
    return jobs.withColumn("code", code).withColumn("state", F.when(which & (s == "queued"), "cancelled").when(which & ~s.isin(*TERMINAL), "cancelling").otherwise(s))


def deletion_code(which: Column) -> Column:
    """204 for jobs of which that go, 409 for those that aren't finished, null for the others."""
    return F.when(which, F.when(F.col("state").isin(*TERMINAL), 204).otherwise(409))


def deleted(jobs: DataFrame, which: Column) -> DataFrame:
    """jobs without those of which that are finished; the others of which stay with code 409."""
    return jobs.withColumn("code", deletion_code(which)).where("code is null or code <> 204")


def page_credit_error(size: Column, most: int) -> Column:
    """Why a page can't be queued at all: its pixels are over the whole byte budget, which fails its job."""
    return F.when(size > most, F.lit("page exceeds the byte limit of ready pages"))


def valid_job_id(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{1,64}$")


def valid_asset(x: Column) -> Column:
    return x.rlike(r"^[^/\\]+\.png$") & ~F.contains(x, F.lit(".."))


def new_job_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def model_metrics(completions: DataFrame) -> DataFrame:
    """For each model: completed, failed, latency, queue, work and token sums. Prompt tokens count only where the total covers the output."""
    good = ~F.col("failed")
    covered = good & (F.col("total_tokens") > 0) & (F.col("total_tokens") >= F.col("output_tokens"))
    return completions.groupBy("model").agg(
        F.count("*").alias("completed"), F.count_if("failed").alias("failed_requests"), F.count_if(good).alias("successful"),
        F.count_if(F.col("failed") & F.col("kind").isin("http_429", "http_503")).alias("overload"), F.round(F.sum("latency_ms"), 4).alias("latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
        F.round(F.sum("queue_ms"), 4).alias("queue_ms"), F.coalesce(F.sum(F.when(good, F.col("work"))), F.lit(0)).cast("bigint").alias("work"),
        F.coalesce(F.sum(F.when(covered, F.col("total_tokens") - F.col("output_tokens"))), F.lit(0)).cast("bigint").alias("prompt_tokens"), F.coalesce(F.sum(F.when(good, F.col("output_tokens"))), F.lit(0)).cast("bigint").alias("output_tokens"),
    )


def failure_kind(cancelled: Column, http_status: Column, message: Column) -> Column:
    """The kind of a failure, by the first that applies."""
    return (
        F.when(cancelled, "cancelled").when(http_status > 0, F.concat(F.lit("http_"), http_status.cast("string")))
        .when(F.contains(message, F.lit("timeout")), "http_timeout").when(F.contains(message, F.lit("connection")), "http_connection")
        .when(F.contains(message, F.lit("response limit")), "http_response_limit").when(F.contains(message, F.lit("transport")), "http_transport").otherwise("model_error")
    )


def failure_counts(completions: DataFrame) -> DataFrame:
    return completions.where("failed").groupBy("model", "kind").agg(F.count("*").alias("n"))


MOST_BIN = 1 << 20


def power_bin(n: Column) -> Column:
    """The least power of two that is at least n, at most MOST_BIN."""
    at = F.ceil(F.log2(F.greatest(F.lit(1), F.least(F.lit(MOST_BIN), n)).cast("double")) - 1e-12)
    return F.least(F.lit(MOST_BIN).cast("bigint"), F.pow(F.lit(2.0), at).cast("bigint"))


def histogram(rows: DataFrame, value: Column, *group: str) -> DataFrame:
    return rows.groupBy(*group, power_bin(value).alias("bin")).agg(F.count("*").alias("n"))


def peaks(intervals: DataFrame, group: str = "model") -> DataFrame:
    """Greatest number of requests, and of their weight, in flight at once: (group, start, end, weight). Ends come before starts."""
    events = intervals.select(group, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("n"), F.col("weight").alias("w")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("n"), (-F.col("weight")).alias("w")))).alias("e")).select(group, "e.*")
    steps = events.groupBy(group, "at", "n").agg(F.sum("n").alias("dn"), F.sum("w").alias("dw"))  # fewer rows to sort
    w = Window.partitionBy(group).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(group, F.sum("dn").over(w).alias("r"), F.sum("dw").over(w).alias("b")).groupBy(group).agg(F.max("r").alias("peak_requests"), F.max("b").alias("peak_weight"))


def latencies(completions: DataFrame, *group: str) -> DataFrame:
    """Nearest-rank percentiles of finished requests."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)")
    return completions.where("not failed").groupBy(*group).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def throughput(completions: DataFrame) -> DataFrame:
    """Successful requests a second of the time from first to last."""
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return completions.agg(F.count_if(~F.col("failed")).alias("successful"), seconds.alias("seconds")).withColumn("per_second", F.when(F.col("seconds") > 0, F.col("successful") / F.col("seconds")))
