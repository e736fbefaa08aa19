"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Targets. Sources share `share` of all words by weight; a source's target stops at `cap` times its size, and what is over goes to the others by
weight until none is above. In order of cap / weight the capped sources come first, so running sums settle all of it at once.

Quotas. Each source's documents are dealt to blocks by a hash of doc_id and text; a source has a block for every `per_block` of its documents,
rounded to a power of two and 1024 at least. Whole passes take every block; the last pass takes the first blocks of a hashed permutation, and of
the block that the target ends in its first documents in hashed order, so that the words taken differ from the target by less than a document;
of TRIES such permutations the one that ends nearest is used. Rows that repeat doc_id and text stand together there, and as many of them are
taken as come nearest. The draws (block, pass) are the source's quota.

Splitting tree. The quotas of all sources are split between the two halves of the shards, then each half's between its halves, and so on; a
split draws, source by source, how many of the source's draws go left: of the places still open on the left, one is taken with the chance that
the urn without replacement gives, place by place, from hashed uniforms. Quotas are kept exactly, and every shard gets its number of draws.
A shard then takes the next draws of the source's permuted sequence, disjoint from the others', and shuffles its documents by hash.

Everything follows from the seed: reruns agree. Defined cases: null text has no words; a null source is a source of its own, sorted last; documents
without words are never taken; a source without words has target 0; rows that share a doc_id (or have none) part by their texts; of rows that
share the text too, each has its turn, and which of them it is makes no difference; a very long text is one document like others; equal
hashes go by doc_id; an empty table gives an empty result; extra columns are ignored, or kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, checkpointed, table

BLOCKS, PER_BLOCK, TRIES = 1024, 1_000_000, 16
_WHOLE = (Window.unboundedPreceding, 0)


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size in words, x (hash of the text), and more."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("x"), *more)


def _hash(seed: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _uniform(seed: int, *columns) -> Column:
    """In [0, 1), from 52 bits of a hash."""
    return F.shiftrightunsigned(_hash(seed, *columns), 12).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """sizes: source, source_size. Adds weight and target. One row a source, so the windows over all of them are small."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / open_weight)
    rows = rows.withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.coalesce(F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(all_rows)["level"], F.lit(0.0))
    return rows.withColumn("open", level).select("source", "source_size", "weight", F.when(F.col("capped"), F.col("most")).otherwise(F.col("open") * F.col("weight")).cast("double").alias("target"))


def _small(df: DataFrame) -> DataFrame:
    """A table of at most BLOCKS * TRIES rows a source, checkpointed in few files."""
    return checkpointed(df.coalesce(4))


def spread(docs: DataFrame, per_block: int, least: int) -> Column:
    """Blocks of a row's source. The driver gets the sources that need more than `least`: one for every per_block * least rows at most."""
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n")).where(F.col("n") > per_block * least)
    out = F.lit(least)
    for r in counts.orderBy("n", "source").collect():
        out = F.when(F.col("source").eqNullSafe(F.lit(r["source"])), F.lit(1 << (-(-r["n"] // per_block) - 1).bit_length())).otherwise(out)
    return out


def blocked(rows: DataFrame, seed: int, n_blocks: Column) -> DataFrame:
    """rows (as sized() gives them) with block: the document's, in its source."""
    return rows.withColumn("block", F.pmod(_hash(seed, "doc_id", "x"), n_blocks).cast("int"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: int = 17, shards: int = 16, n_blocks: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, source, size, x, block; blocks: source, block, source_size, target, passes, within, words, upto, part, shards). A
    block's shards are those of its draws, pass after pass; upto is the hash up to which documents of the block that the target ends in are
    taken, part the hash of repeated rows of which only the first `n` are."""
    own = checkpointed(blocked(sized(docs), seed, spread(docs, PER_BLOCK, BLOCKS) if n_blocks is None else n_blocks))
    blocks = own.groupBy("source", "block").agg(F.sum("size").alias("words"))
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap).withColumnRenamed("source", "s")
    # a row for each block of a source from here on
    dealt = blocks.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("source", "block", "words", "source_size", "target")
    dealt = dealt.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    dealt = dealt.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    # TRIES hashed permutations a source, of which the one that ends nearest to the target is taken
    dealt = dealt.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    order = Window.partitionBy("source", "turn").orderBy(_hash(seed + 1, "turn", "source", "block"), "block")
    filled = F.sum((F.col("words") > 0).cast("long"))
    dealt = dealt.withColumn("nth", filled.over(order.rowsBetween(*_WHOLE)) - 1).withColumn("start", F.sum("words").over(order.rowsBetween(*_WHOLE)) - F.col("words"))
    dealt = dealt.withColumn("n_blocks", filled.over(Window.partitionBy("source", "turn")))
    # words of the last pass that fall into the block
    dealt = dealt.withColumn("within", F.greatest(F.lit(0.0), F.least(F.col("rest") - F.col("start"), F.col("words").cast("double"))))
    cut = (F.col("within") > 0) & (F.col("within") < F.col("words"))
    # only the block that the target ends in is put in order
    ends = dealt.where(cut).select(F.col("source").alias("s"), F.col("block").alias("b"), "turn", "within")
    ended = own.where("size > 0").join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("h", _hash(seed + 2, "turn", "doc_id", "x"))
    # rows that repeat doc_id and text: `copies` of one
    ended = ended.groupBy("s", "b", "turn", "within", "h", "doc_id", "x", "size").agg(F.count("*").alias("copies")).withColumn("all", F.col("size") * F.col("copies"))
    running = Window.partitionBy("s", "b", "turn").orderBy("h", "doc_id", "x", "size").rowsBetween(*_WHOLE)
    before = F.sum("all").over(running) - F.col("all")
    ended = ended.withColumn("n", F.greatest(F.lit(0), F.least(F.col("copies"), F.floor((F.col("within") - before) / F.col("size") + 0.5))).cast("long"))
    some = (F.col("n") > 0) & (F.col("n") < F.col("copies"))
    upto = _small(
        ended.groupBy("s", "b", "turn", "within").agg(
            F.max(F.when(F.col("n") == F.col("copies"), F.col("h"))).alias("upto"), F.max(F.when(some, F.struct("h", "n"))).alias("part"), F.sum(F.col("n") * F.col("size")).alias("got")
        )
    )
    off = upto.select("s", F.struct(F.abs(F.col("got") - F.col("within")).alias("off"), "turn").alias("best"))
    best = off.groupBy("s").agg(F.min("best")["turn"].alias("chosen")).withColumnRenamed("s", "c")
    dealt = dealt.join(best, F.col("source").eqNullSafe(F.col("c")), "left").where(F.col("turn") == F.coalesce("chosen", F.lit(0))).drop("c", "chosen")
    dealt = _small(dealt.withColumn("draws", F.when(F.col("words") > 0, F.col("passes") + (F.col("within") > 0).cast("long")).otherwise(0).cast("long")))
    # the shard of every draw; a source's sequence is its permuted blocks, pass after pass
    none = F.array().cast("array<bigint>")
    each = dealt.select("source", "block", F.explode(F.when(F.col("draws") > 0, F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)).otherwise(none)).alias("copy"), "n_blocks", "nth")
    each = each.withColumn("draw", F.col("copy") * F.col("n_blocks") + F.col("nth"))
    cuts = _small(splits(dealt, shards, seed)).where(F.col("count") > 0).withColumnRenamed("source", "s")
    placed = each.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("first") + F.col("count")))
    placed = placed.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))
    keyed = dealt.select("source", "block", "source_size", "target", "passes", "within", "words", "turn")
    upto, placed = upto.select(F.col("s").alias("us"), F.col("b").alias("ub"), F.col("turn").alias("ut"), "upto", "part"), placed.select(F.col("source").alias("ps"), F.col("block").alias("pb"), "shards")
    keyed = keyed.join(upto, F.col("source").eqNullSafe(F.col("us")) & (F.col("block") == F.col("ub")) & (F.col("turn") == F.col("ut")), "left").drop("us", "ub", "ut")
    keyed = keyed.join(placed, F.col("source").eqNullSafe(F.col("ps")) & (F.col("block") == F.col("pb")), "left").drop("ps", "pb")
    return own, _small(keyed)


def placed(rows: DataFrame, blocks: DataFrame, seed: int, most: int = 100_000) -> DataFrame:
    """rows (as blocked() gives them, and more) with source_size, target and shards: one for every time the mix takes the row. blocks is
    broadcast only if it has at most `most` rows."""
    kept = [c for c in rows.columns if c != "block"]
    side = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), *[c for c in blocks.columns if c not in ("source", "block")])
    side = F.broadcast(side) if blocks.count() <= most else side
    out = rows.join(side, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("h", _hash(seed + 2, "turn", "doc_id", "x"))
    in_rest = (F.col("within") >= F.col("words")) | F.coalesce(F.col("h") <= F.col("upto"), F.lit(False))
    repeated = F.coalesce(F.col("h") == F.col("part.h"), F.lit(False))
    if blocks.where("part is not null").limit(1).count():  # rows that are alike, of which some are taken
        nth = F.row_number().over(Window.partitionBy("s", "b").orderBy("h"))
        some = out.where(repeated & (F.col("size") > 0)).withColumn("rest", nth <= F.col("part.n"))
        out = out.where(~repeated | (F.col("size") == 0)).withColumn("rest", in_rest).unionByName(some)
    else:
        out = out.withColumn("rest", in_rest)
    times = F.when(F.col("size") > 0, F.col("passes") + (F.col("rest") & (F.col("within") > 0)).cast("long")).otherwise(0).cast("int")
    return out.select(*kept, "source_size", "target", F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), times).alias("shards"))


def splits(dealt: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """source, shard, first, count: the part of the source's sequence of draws that each shard gets, by the splitting tree. The draws of a source
    are its blocks of the first pass in permuted order, then those of the second, and so on; at most BLOCKS * (cap + 1) a source."""
    n = F.sum("draws")
    node = dealt.groupBy("source").agg(n.alias("count")).select("source", F.lit(0).alias("low"), F.lit(shards).alias("width"), "count")
    by_node = Window.partitionBy("low", "width")
    in_order = by_node.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    while shards > 1:
        half = F.floor(F.col("width") / 2).cast("int")
        total = F.sum("count").over(by_node)
        node = node.withColumn("total", total).withColumn("open_left", F.floor(F.col("total") * half / F.col("width")).cast("long")).withColumn("before", F.coalesce(F.sum("count").over(in_order), F.lit(0)).cast("long"))
        node = node.withColumn("here", F.struct("source", "count", "before"))
        # the urn of a node, source by source: (places open on the left, draws not yet placed)
        urns = node.groupBy("low", "width", "total", "open_left").agg(F.array_sort(F.collect_list("here")).alias("sources"))

        def urn(row):
            def draw(state, j):
                u = _uniform(seed + 3, "low", "width", row["source"], j)
                left = (u * state["remaining"] < state["open"]).cast("long")
                return F.struct((state["open"] - left).alias("open"), (state["remaining"] - 1).alias("remaining"), (state["left"] + left).alias("left"))

            return draw

        def source(state, row):
            inner = F.aggregate(
                F.when(row["count"] > 0, F.sequence(F.lit(1).cast("long"), row["count"])).otherwise(F.array().cast("array<bigint>")),
                F.struct(state["open"].alias("open"), state["remaining"].alias("remaining"), F.lit(0).cast("long").alias("left")),
                urn(row),
            )
            done = F.concat(state["done"], F.array(F.struct(row["source"].alias("source"), row["count"].alias("count"), inner["left"].alias("left"))))
            return F.struct(inner["open"].alias("open"), inner["remaining"].alias("remaining"), done.alias("done"))

        nothing = F.array().cast("array<struct<source:string,count:bigint,left:bigint>>")
        done = F.aggregate("sources", F.struct(F.col("open_left").alias("open"), F.col("total").alias("remaining"), nothing.alias("done")), source)["done"]

        def child(row, low, width, count):
            return F.struct(row["source"].alias("source"), low.cast("int").alias("low"), width.cast("int").alias("width"), count.alias("count"))

        low, width = F.col("low"), F.col("width")
        halves = lambda row: F.when(width > 1, F.array(child(row, low, half, row["left"]), child(row, low + half, width - half, row["count"] - row["left"]))).otherwise(F.array(child(row, low, width, row["count"])))
        node = urns.select(F.inline(F.flatten(F.transform(done, halves))))
        shards = (shards + 1) // 2
    by_source = Window.partitionBy("source").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    return node.select("source", F.col("low").alias("shard"), F.coalesce(F.sum("count").over(by_source), F.lit(0)).cast("long").alias("first"), "count")


def mixed(docs: DataFrame, shards: int = 16, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """docs' columns and size, source_size, target, copy (from 0), shard, position (the hashed place by which a shard is put in order), in place
    of columns of those names: a row for every time the mix takes a document. Texts aren't shuffled."""
    n_blocks = spread(docs, PER_BLOCK, BLOCKS)
    _, blocks = plan(docs, weights, share, cap, seed, shards, n_blocks)
    rows = blocked(sized(docs, F.struct(*docs.columns).alias("row")), seed, n_blocks)
    out = placed(rows, blocks, seed).select("row", "doc_id", "x", "size", "source_size", "target", F.posexplode("shards").alias("copy", "shard"))
    new = ["size", "source_size", "target", "copy", "shard", _hash(seed + 4, "shard", "doc_id", "x", "copy").alias("position")]
    own = ("size", "source_size", "target", "copy", "shard", "position")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in own], *new)


def in_shards(mix: DataFrame, files: int) -> DataFrame:
    """mixed()'s rows in the order of shard and position: a partition holds a run of that order, so that a shard is some whole files and the
    ends of two, each in shuffled order; no partition follows a shard's size."""
    return mix.repartitionByRange(files, "shard", "position").sortWithinPartitions("shard", "position")


def op5_mixing(spark: SparkSession, sf_dir: str, seed: int = 17) -> DataFrame:
    """The words that the mix takes of each document: its size for every shard that one of its draws fell to."""
    own, blocks = plan(table(spark, sf_dir, "documents"), seed=seed)
    return placed(own, blocks, seed).select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"))
