"""Source mixing by weighted fair queueing.

Targets: the budget (a share of all words) is split by weight, no source above ``cap`` times its words,
the excess reshared by weight. Each source's documents are shuffled by a seeded hash; a document's virtual
finish time is the source's words up to and with it, divided by the source's target, one turn after the
other. All turns of all documents are put in order of that time (ranges of it, sorted inside), the sequence's running sum of
words is formed, and the sequence is truncated where it reaches the total budget.

The mixed corpus is what lies before the cut, whole documents. The report then serves the documents in service at the
cut in part, as the fluid model that fair queueing follows: what a source has more or less than its target by
whole documents is given or taken at the border of its own queue, so sources hit their targets to a word.

Running sums never gather a source or the sequence in one task: a source's hash order is cut into ``BUCKETS`` ranges and the
virtual time into as many as hold about ``RANGE_ROWS`` turns each (sources fill them evenly), summed per range first, then inside each range.
All of it is built-in functions.

Defined results: null texts and texts without words have size 0 and take 0 words; a null source is a
source of its own, the last in order; a source without words takes nothing; an empty table gives an empty table; repeated rows are
documents of their own; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, materialize, text_or_empty, word_count

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, 20_011
BUCKETS, RANGE_ROWS = 4096, 8192
#: Source tables of up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_SOURCES = 50_000


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """skey, source_size, target: one row per source. The windows order sources, never documents."""
    totals = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size").cast("double") * cap)
    by_ratio = W.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    every = W.partitionBy(F.lit(0))
    levels = weighed.select(
        "*",
        F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)).alias("open_weight"),
        (F.sum("source_size").over(every).cast("double") * share).alias("budget"),
    ).withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open_weight"))
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("r"), "level"))
    level = F.min(fits).over(every)["level"]
    return levels.select("skey", "source_size", F.coalesce(F.least("most", level * F.col("weight")), F.col("most")).alias("target"))


def place_keys(seed: int) -> list:
    """skey, order, tie: a document's source and its place in the source's shuffled order (then doc_id)."""
    source, tie = F.col("source").cast("string"), F.crc32(text_or_empty().cast("binary"))
    return [F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("skey"), F.xxhash64("doc_id", tie, F.lit(seed)).alias("order"), tie.alias("tie")]


def queue(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> tuple[DataFrame, float]:
    """doc_id, skey, order, tie, size, source_size, target and start (the source's words before it in its shuffled order) of every document; the budget."""
    keys = [F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"), *place_keys(seed)]
    bucket = F.shiftright("order", 64 - BUCKETS.bit_length() + 1).cast("int")
    # A table of keys: texts are read once and never shuffled.
    sized = materialize(docs.select("doc_id", *keys), "mix-sizes").withColumn("bucket", bucket)
    targets = materialize(source_targets(sized, weights, share, cap), "mix-targets")
    sources, budget = targets.agg(F.count(F.lit(1)), F.sum("target")).first()
    ranges = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select("skey", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    inner = W.partitionBy("skey", "bucket").orderBy("order", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(ranges, ["skey", "bucket"])
    placed = placed.join(F.broadcast(targets) if sources <= BROADCAST_SOURCES else targets, "skey").withColumn("start", F.col("base") + F.col("inside"))
    return materialize(placed.select("doc_id", "skey", "order", "tie", "size", "source_size", "target", "start"), "mix-queue"), budget or 0.0


def turns(placed: DataFrame, cap: int = CAP) -> DataFrame:
    """A row for each turn of a document of a source with a target: turn, at (words of its source before it) and finish (virtual)."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), (F.col("start") + F.col("source_size") * t).alias("at")) for t in range(cap)]))
    spread = placed.where(F.col("target") > 0).withColumn("t", each).select("*", "t.*").drop("t")
    return spread.withColumn("finish", (F.col("at") + F.col("size")) / F.col("target"))


def running(sequence: DataFrame, ties: list[str]) -> DataFrame:
    """Adds words: the sum of size up to and with each row, in order of (finish, ties)."""
    count = sequence.count()
    ranges = max(1, -(-count // RANGE_ROWS))
    ranged = sequence.withColumn("range", F.floor(F.col("finish") * ranges).cast("long"))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("words"))
    # The windows over ranges are cut themselves: first into hundreds of ranges, then those.
    high = sums.groupBy(F.expr("range div 512").alias("high")).agg(F.sum("words").alias("words"))
    before = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    high = high.select("high", before(W.partitionBy(F.lit(0)).orderBy("high")).alias("far"))
    near = sums.withColumn("high", F.expr("range div 512")).withColumn("near", before(W.partitionBy("high").orderBy("range")))
    bases = near.join(high, "high").select("range", (F.col("near") + F.col("far")).alias("base"))
    inside = W.partitionBy("range").orderBy("finish", *ties).rowsBetween(W.unboundedPreceding, 0)
    return ranged.withColumn("inside", F.sum("size").over(inside)).join(bases, "range").withColumn("words", F.col("base") + F.col("inside")).drop("base", "inside", "range")


def truncated(placed: DataFrame, budget: float, cap: int = CAP) -> DataFrame:
    """The turns before the cut: the sorted sequence up to the total budget."""
    sequence = materialize(turns(placed, cap), "mix-turns")
    return running(sequence, ["skey", "turn", "start", "doc_id"]).where(F.col("words") <= F.lit(round(budget)))


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, and whole (its words before the cut of the sequence, in whole documents)."""
    placed, budget = queue(docs, weights, share, cap, seed)
    # A source's turns before the cut are the first of its queue: their words are the place where its queue is cut.
    cuts = truncated(placed, budget, cap).groupBy("skey").agg(F.sum("size").alias("end"))
    cuts = materialize(cuts, "mix-cuts")
    few = cuts.count() <= BROADCAST_SOURCES
    cut = placed.join(F.broadcast(cuts) if few else cuts, "skey", "left").withColumn("end", F.coalesce("end", F.lit(0)))
    # What whole documents leave to the source's target, or have beyond it, is served by or taken back from those at the border.
    border = F.round("target").cast("long") - F.col("end")

    def served(end):
        total = F.lit(0)
        for t in range(cap):
            total = total + F.greatest(F.lit(0), F.least(F.col("size"), end - F.col("start") - F.col("source_size") * t))
        return total.cast("long")

    return cut.select("doc_id", "size", "source_size", "target", served(F.col("end") + border).alias("taken"), served(F.col("end")).alias("whole"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` that the truncated sequence holds, a row again for each further turn.

    The sequence is formed on keys. What it holds of a source are the first turns of that source's queue, so the last of them, one
    place for each source, tells every row where it lies whether it is in: whole rows are never shuffled. Rows of one doc_id and text
    share a place. A document without words goes along once if its place lies before the cut.
    """
    names = docs.columns
    placed, budget = queue(docs, weights, share, cap, seed)
    last = F.max(F.struct("turn", "order", "doc_id", "tie")).alias("__last")
    cuts = materialize(truncated(placed, budget, cap).groupBy(F.col("skey").alias("__skey")).agg(last), "mix-cuts")
    few = cuts.count() <= BROADCAST_SOURCES
    keys = [k.alias(n) for k, n in zip(place_keys(seed), ("__skey", "__order", "__tie"))]
    rows = docs.select("*", *keys).join(F.broadcast(cuts) if few else cuts, "__skey")
    rows = rows.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    place = F.struct(F.col("__turn").alias("turn"), F.col("__order").alias("order"), F.col("doc_id").alias("doc_id"), F.col("__tie").alias("tie"))
    wordless = F.btrim(text_or_empty(), F.lit(BLANKS)) == ""
    return rows.where((place <= F.col("__last")) & ((F.col("__turn") == 0) | ~wordless)).select(*[F.col(f"`{c}`") for c in names])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
