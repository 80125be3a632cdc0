"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

The leaves are the shards. A node that holds k shards is split along the dimension in which its documents
spread widest, at the point where the bytes left of it are the left shards' part; with k a power of two
that is the weighted median at every node. The point is found by histograms: each round counts bytes in
``BINS`` bins of every open node at once and looks into the bin that holds the point, until that bin is
negligible or one single key. Keys are the dimension's value followed by bits of the text's and the
document's hash, so ties (a hot source, a group of copies) can be cut anywhere.

No point divides a document. Where one larger than 1/``HEAVY`` of a shard lies across the median it goes to one side whole, and
the light documents' point of that node is moved along the same dimension until the bytes balance again: a node cuts its
heavy documents at the median of all, its light ones beside it. Every document is a weighted point of the tree. Everything is built-in
functions; the driver sees the tree, a few numbers for each shard.

Law ``bytes``: shards' sizes are near equal. Slots run gapless from 0 in each shard; they are counted
in hash buckets, so no task holds a shard.

Defined results: null texts count as empty (0 bytes plus 8, crc32 0); null metadata sort lowest; repeated
rows are documents of their own; a document larger than a shard makes its shard larger; an empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_or_empty, values

SHARDS, BINS, HEAVY, SLOT_BUCKETS = 24, 4096, 32, 256
#: A split point may miss by this part of a shard.
TOLERANCE = 0.0005
TIE_BITS = 32


def text_rank(column: str) -> Column:
    """An order-preserving number of a string's first six bytes."""
    head = F.rpad(F.hex(F.substring(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def dimensions() -> list[Column]:
    """Metadata in which documents are near each other: length (log), source, language, id."""
    return [F.log2(F.col("size").cast("double")), text_rank("source"), text_rank("lang"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0))]


def document_meta(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, keys: one order-preserving long per dimension, ties told apart."""
    text = text_or_empty().cast("binary")
    sized = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dims = dimensions()
    raw = materialize(sized.select("doc_id", "size", "text_crc32", F.array(*dims).alias("dims")), "shard-meta")
    ends = raw.agg(*[f(F.col("dims")[i]) for i in range(len(dims)) for f in (F.min, F.max)]).first()
    tie = F.shiftleft(F.col("text_crc32").bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(0xFFFF)))
    keys = []
    for i in range(len(dims)):
        low, high = ends[2 * i] or 0.0, ends[2 * i + 1] or 0.0
        part = (F.col("dims")[i] - F.lit(low)) / F.lit((high - low) or 1.0)
        keys.append(F.shiftleft(F.round(part * F.lit(float(2**30))).cast("long"), TIE_BITS) + tie)
    return materialize(raw.select("doc_id", "size", "text_crc32", F.array(*keys).alias("keys")), "shard-keys")


def split_points(placed: DataFrame, goals: dict[int, tuple[int, float]], spans: dict[int, list], tolerance: float) -> dict[int, int]:
    """goals: node -> (dimension, bytes wanted left); spans: node -> [least key, largest key, 0]. Returns node -> largest key that goes left."""
    spark = placed.sparkSession
    dims = values(spark, [(n, d) for n, (d, _) in goals.items()], "node long,dim int")
    keyed = placed.join(F.broadcast(dims), "node").select("node", "size", F.element_at("keys", F.col("dim") + 1).alias("key"))
    found: dict[int, int] = {}
    while spans:
        width = {n: max(1, -(-(high - low + 1) // BINS)) for n, (low, high, _) in spans.items()}
        asked = values(spark, [(n, low, high, width[n], float(goals[n][1] - base)) for n, (low, high, base) in spans.items()], "node long,low long,high long,width long,goal double")
        inside = keyed.join(F.broadcast(asked), "node").where(F.col("key").between(F.col("low"), F.col("high")))
        bins = inside.groupBy("node", F.expr("(key - low) div width").alias("bin"), "goal").agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
        upto = bins.withColumn("upto", F.sum("bytes").over(W.partitionBy("node").orderBy("bin")))
        at = upto.where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("bytes") < F.col("goal")))
        hits = {r.node: r for r in at.collect()}
        for n, (low, high, base) in list(spans.items()):
            r = hits.get(n)
            if r is None:  # nothing is wanted left, or all of it
                found[n] = low - 1 if goals[n][1] <= base else high
            elif r["first"] == r["last"] or r["bytes"] <= tolerance:
                found[n] = r["last"] if r["upto"] - r["goal"] <= r["goal"] - (r["upto"] - r["bytes"]) else r["first"] - 1
            else:
                spans[n] = [r["first"], r["last"], base + r["upto"] - r["bytes"]]
                continue
            del spans[n]
    return found


def cut_points(placed: DataFrame, goals: dict[int, tuple[int, float]], spans: dict[int, list], tolerance: float, heavy: float | None) -> dict[int, tuple[int, int]]:
    """Node -> largest keys that go left, of documents up to ``heavy`` bytes and of larger ones (None: there are none)."""
    points = split_points(placed, goals, {n: list(x) for n, x in spans.items()}, tolerance)
    moved: dict[int, int] = {}
    if heavy is not None:
        asked = values(placed.sparkSession, [(n, goals[n][0], points[n]) for n in goals], "node long,dim int,point long")
        over = placed.where(F.col("size") > heavy).join(F.broadcast(asked), "node")
        left = over.groupBy("node").agg(F.sum(F.when(F.element_at("keys", F.col("dim") + 1) <= F.col("point"), F.col("size")).otherwise(0)).alias("left")).collect()
        light = {r.node: (goals[r.node][0], goals[r.node][1] - r.left) for r in left}
        if light:
            moved = split_points(placed.where(F.col("size") <= heavy), light, {n: list(spans[n]) for n in light}, tolerance)
    return {n: (moved.get(n, point), point) for n, point in points.items()}


def kd_shards(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard: ``shards`` leaves, or as many as hold ``target_bytes`` each."""
    spark = docs.sparkSession
    meta = document_meta(docs)
    total, largest = meta.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    mean = total / shards
    heavy = mean / HEAVY if largest > mean / HEAVY else None
    placed = meta.withColumn("node", F.lit(0).cast("long"))
    leaves, open_nodes, fresh, level = {}, {0: (0, shards)}, 1, 0
    while open_nodes:
        leaves |= {n: first for n, (first, count) in open_nodes.items() if count == 1}
        open_nodes = {n: x for n, x in open_nodes.items() if x[1] > 1}
        if not open_nodes:
            break
        dims = range(len(dimensions()))
        # Leaves of earlier levels are left out; their numbers lie below those of the open nodes or are few.
        spread = placed.where(F.col("node") >= min(open_nodes))
        spread = spread.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(F.col("keys")[d]).alias(f"{name}{d}") for d in dims for f, name in ((F.min, "low"), (F.max, "high"))])
        stats = {r.node: r for r in spread.collect() if r.node in open_nodes}
        goals, spans, splits, after = {}, {}, [], {}
        for n, (first, count) in open_nodes.items():
            half = count // 2
            left, right = fresh, fresh + 1
            fresh += 2
            after |= {left: (first, half), right: (first + half, count - half)}
            if n in stats:
                r = stats[n]
                widest = max(dims, key=lambda d: ((r[f"high{d}"] >> TIE_BITS) - (r[f"low{d}"] >> TIE_BITS), -d))
                goals[n] = (widest, r.bytes * half / count)
                spans[n] = [r[f"low{widest}"], r[f"high{widest}"], 0]
                splits.append((n, left, right))
        points = cut_points(placed, goals, spans, TOLERANCE * mean, heavy) if goals else {}
        cuts = values(spark, [(n, goals[n][0], *points[n], a, b) for n, a, b in splits], "node long,dim int,light long,heavy long,below long,above long")
        point = F.when(F.col("size") <= F.lit(heavy), F.col("light")).otherwise(F.col("heavy")) if heavy is not None else F.col("light")
        placed = placed.join(F.broadcast(cuts), "node", "left").withColumn(
            "node", F.when(F.col("dim").isNull(), F.col("node")).when(F.element_at("keys", F.col("dim") + 1) <= point, F.col("below")).otherwise(F.col("above"))
        ).drop("dim", "light", "heavy", "below", "above")
        open_nodes, level = after, level + 1
        if level % 4 == 0:
            placed = materialize(placed, "shard-level")
    named = values(spark, list(leaves.items()), "node long,shard int")
    return placed.join(F.broadcast(named), "node", "left").select("doc_id", "size", "text_crc32", "shard")


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: gapless from 0 in each shard."""
    dealt = materialize(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)).cast("int")), "shard-placed")
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "bucket", base.alias("base"))
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("inside", inside).join(counts, ["shard", "bucket"]).withColumn("slot", (F.col("base") + F.col("inside")).cast("long")).drop("base", "inside", "bucket")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_slots(kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
