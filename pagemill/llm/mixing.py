"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Sources in order of code points, null last, weigh 3, 1, 2, repeating. Together they get SHARE of all words; no source gets
more than twice its own, and what is over goes to the others by weight. A source's documents are dealt by a hash into blocks
(BLOCKS over all sources, in proportion to their words). It takes all its blocks once for each whole pass that its target
holds, then blocks in a permuted order, and of the last block the documents up to the target in order of their hash.

The block copies so drawn are each source's quota. A binary tree splits the quotas among the output shards: at each node the
left half of the shards gets a multivariate-hypergeometric draw of the node's blocks, source by source, so every shard's mix
is that of a random deal of all blocks without one. Shard s then takes the next of its source's permuted block copies.
Tables of blocks and of sources are small by construction; documents are only joined with them, never sorted together.

Defined cases: a null text has no words; null source is a source of its own; a null doc_id counts as one id; rows that share
an id are taken together; a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import SPACED_WORD, materialise

SHARE, MOST_PASSES = 1.5, 2
WEIGHTS = (3, 1, 2)
BLOCKS, SHARDS = 4096, 16
#: Rows of the tables of blocks and of sources up to which they are broadcast (some 100 bytes each).
BROADCAST_ROWS = 100_000
ALL = (1 << 62) - 1


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def order_key(*parts: Column) -> Column:
    """A number of 60 bits that only depends on its parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 15), 16, 10).cast("bigint")


def doc_key(doc_id: Column) -> Column:
    return order_key(F.lit("doc"), F.coalesce(doc_id.cast("string"), F.lit("null")))


def sources(sized: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, blocks: int = BLOCKS) -> DataFrame:
    """A row for each source of sized (source, size): its number, words, weight, target, whole passes, rest and number of blocks."""
    every, most = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    by_room = Window.orderBy("room", "number")
    t = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("number", F.row_number().over(every) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("number") % len(weights) + 1))
        .withColumn("total", F.sum("source_size").over(most))
        .withColumn("most", F.col("source_size") * MOST_PASSES)
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") * share - F.col("full")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("most") >= F.col("weight") * F.col("level"), F.struct("room", "number", "level"))).over(most)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")))
    passes = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.lit(MOST_PASSES), F.floor(F.col("target") / F.col("source_size")))).cast("int")
    return (
        t.withColumn("target", target).withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("blocks", F.expr(f"IF(total = 0, 1, greatest(1, ({blocks} * source_size + total - 1) div total))").cast("bigint"))
        .select("source", "number", "source_size", "target", "passes", "rest", "blocks")
    )


def drawn(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """Block copies that the mix takes: source number, block, pass, and cut, the greatest document key that is taken."""
    hinted = F.broadcast if by_source.count() <= BROADCAST_ROWS else lambda df: df  # none has more rows than by_source
    keyed = sized.join(hinted(by_source.select(F.col("source").alias("s"), "number", "blocks", "rest")), F.col("source").eqNullSafe(F.col("s")))
    keyed = keyed.withColumn("key", doc_key(F.col("doc_id"))).withColumn("block", F.col("key") % F.col("blocks"))
    in_order = Window.partitionBy("number").orderBy("rank", "block")
    sums = (
        keyed.groupBy("number", "block", "rest").agg(F.sum("size").alias("words"))
        .withColumn("rank", order_key(F.lit("block"), F.col("number"), F.col("block")))
        .withColumn("after", F.sum("words").over(in_order))
        .withColumn("before", F.col("after") - F.col("words"))
    )
    sums = materialise(sums, "blocks")
    whole = sums.where("after <= rest").select("number", "block", F.lit(ALL).alias("cut"))
    last = sums.where("before < rest and after > rest").select("number", "block", (F.col("rest") - F.col("before")).alias("want"))
    by_key = Window.partitionBy("number", "block").orderBy("key")
    cuts = (
        keyed.drop("rest").join(hinted(last), ["number", "block"])
        .groupBy("number", "block", "want", "key").agg(F.sum("size").alias("words"))
        .withColumn("after", F.sum("words").over(by_key))
        .where(F.col("after") - F.col("words") / 2 <= F.col("want"))
        .groupBy("number", "block").agg(F.max("key").alias("cut"))
    )
    partial = whole.unionByName(cuts).join(hinted(by_source.select("number", "passes")), "number").select("number", "block", F.col("passes").alias("pass"), "cut")
    full = sums.select("number", "block").join(hinted(by_source.select("number", "passes").where("passes > 0")), "number")
    full = full.select("number", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"), F.lit(ALL).alias("cut"))
    return full.unionByName(partial)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """Split quotas (number, quota) among shards: shard, number, quota. Every shard gets a like number of blocks."""
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("number", F.col("quota").cast("bigint").alias("quota")))).alias("quotas"))
    tree = tree.select(F.lit(0).alias("first"), F.lit(shards).alias("shards"), "quotas")
    size = "aggregate(quotas, 0L, (a, q) -> a + q.quota)"
    # Of a source's quota, each block in turn goes left with probability (left's open places) / (blocks not yet dealt).
    chance = f"shiftrightunsigned(xxhash64({seed}, first, shards, q.number, j), 11) / 9007199254740992D"
    left = f"""
        aggregate(quotas, named_struct('open', wanted, 'rest', total, 'out', cast(array() as array<struct<number:int,quota:bigint>>)),
          (acc, q) -> aggregate(array(aggregate(IF(q.quota = 0, array(), sequence(1L, q.quota)), 0L,
              (n, j) -> n + IF({chance} * (acc.rest - j + 1) < acc.open - n, 1L, 0L))), acc,
            (a, n) -> named_struct('open', a.open - n, 'rest', a.rest - q.quota,
              'out', concat(a.out, array(named_struct('number', q.number, 'quota', n))))),
          acc -> acc.out)"""
    for _ in range(max(0, (shards - 1).bit_length())):
        wanted = tree.withColumn("half", F.expr("cast(ceil(shards / 2) as int)")).withColumn("total", F.expr(size)).withColumn("wanted", F.expr("total * half div shards"))
        parted = wanted.withColumn("dealt", F.expr(f"IF(shards = 1, quotas, {left})"))
        rest = "transform(quotas, (q, i) -> named_struct('number', q.number, 'quota', q.quota - dealt[i].quota))"
        both = F.expr(f"IF(shards = 1, array(named_struct('first', first, 'shards', 1, 'quotas', quotas)), array(named_struct('first', first, 'shards', half, 'quotas', dealt), named_struct('first', first + half, 'shards', shards - half, 'quotas', {rest})))")
        tree = parted.select(F.explode(both).alias("x")).select("x.*")
    return tree.select(F.col("first").alias("shard"), F.explode("quotas").alias("x")).select("shard", "x.number", "x.quota")


def placed(copies: DataFrame, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """A row for each source number and block: its copies, each with pass, cut and the shard that takes it."""
    split = split_quotas(copies.groupBy("number").agg(F.count("*").alias("quota")), shards, seed)
    upto = Window.partitionBy("number").orderBy("shard")
    ranges = split.withColumn("to", F.sum("quota").over(upto)).withColumn("from", F.col("to") - F.col("quota")).where("quota > 0").select(F.col("number").alias("n"), "shard", "from", "to")
    permuted = Window.partitionBy("number").orderBy(order_key(F.lit("copy"), F.col("number"), F.col("block"), F.col("pass")), "block", "pass")
    ranked = copies.withColumn("rank", F.row_number().over(permuted) - 1)
    taken = ranked.join(ranges, (F.col("number") == F.col("n")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    return taken.groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "cut", "shard"))).alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    return materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")


class Mix:
    """The plan of a mix of docs (doc_id, source, text)."""

    def __init__(self, docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 1):
        self.sizes = sized(docs)
        self.sources = materialise(sources(self.sizes, share, weights, blocks), "sources")
        self.blocks = materialise(placed(materialise(drawn(self.sizes, self.sources), "copies"), shards, seed), "placed")
        self.small = max(self.blocks.count(), self.sources.count()) <= BROADCAST_ROWS

    def assigned(self, docs: DataFrame) -> DataFrame:
        """docs with source_size, target and copies: an array of (pass, cut, shard), one for each time the row is taken."""
        by_source = self.sources.select(F.col("source").alias("_s"), F.col("number").alias("_n"), "source_size", "target", F.col("blocks").alias("_m"))
        by_block = self.blocks.select(F.col("number").alias("_b"), F.col("block").alias("_k"), F.col("copies").alias("_copies"))
        out = docs.join(F.broadcast(by_source) if self.small else by_source, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_key", doc_key(F.col("doc_id")))
        out = out.join(F.broadcast(by_block) if self.small else by_block, (F.col("_n") == F.col("_b")) & (F.col("_key") % F.col("_m") == F.col("_k")), "left")
        kept = F.filter(F.coalesce("_copies", F.array().cast("array<struct<pass:int,cut:bigint,shard:int>>")), lambda c: F.col("_key") <= c["cut"])
        return out.withColumn("copies", kept).drop("_s", "_n", "_m", "_b", "_k", "_copies", "_key")


def taken(docs: DataFrame, **options) -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target, taken and shards (of each copy)."""
    mix = Mix(docs, **options)
    out = mix.assigned(mix.sizes)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), F.transform("copies", lambda c: c["shard"]).alias("shards"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix's rows, repeats included, with docs' own columns: each shard together, in an order of its own."""
    inner = docs.select("doc_id", "source", F.struct("*").alias("_row"))
    rows = Mix(docs, **options).assigned(inner).select("_row", "doc_id", F.explode("copies").alias("_c"))
    rows = rows.withColumn("_o", order_key(F.lit("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_c")["pass"], F.col("_c")["shard"]))
    pieces = max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHARDS)  # of a shard, so that tasks stay small
    return rows.repartition(F.col("_c")["shard"], F.col("_o") % pieces).sortWithinPartitions(F.col("_c")["shard"], "_o").select("_row.*")
