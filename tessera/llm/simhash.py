"""SimHash near-duplicates: vantage-point trees over fingerprints.

Fingerprints: the text's A-Z are lower-cased, words are maximal runs without space and the code points 9
to 13, shingles are space-joined word n-grams, repeats included (the whole sequence where there are fewer
words). A bit is set if it is set in over half of the shingles' XXH64 (seed 42); without words the
fingerprint is zero.

Links: equal fingerprints are one point. A vantage-point tree is grown on a bounded sample; a node splits
by distance to its vantage point at a median m, and a point goes inside if its distance is at most m + r,
outside if it is over m. Two points within r of each other then share a side at every node (triangle
bound), so a pair is found in some leaf, and the leaves are independent shards. Shards of over ``SHARD_POINTS`` points are dealt
again by trees of their own, grown on samples of theirs by the executors, until none is larger; one that no split helps is compared
as pairs of blocks. So a task's points are bounded whatever the table. A shard grows its own
tree the same way down to leaves of ``LEAF`` points, compares there, and returns its components as stars, never
all pairs. Stars of all shards are joined by alternating large-star and small-star rounds over tables.

``near_duplicates`` finds texts with a given Jaccard similarity of shingle sets, by the same steps: fingerprints (of the distinct
shingles), vantage-point shards and star components at ``RADIUS`` bits. In each component, every pair that can reach the similarity by size and
by its rarest shingles (an exact prefix filter) is decided on the whole shingle sets. At similarity 0.8 two fingerprints differ in about 10 of
64 bits, and no radius that prunes holds all such pairs (unrelated ones lie at 32 +- 4), so texts of different components also meet
in partitions by pairs of min-wise shingles (``BANDS`` of them; a pair at 0.8 shares one with probability 0.998), where they are decided the same way; a
partition whose texts are all of one component is left out, since its pairs were met there.
Components and partitions of over ``GROUP_BLOCK`` texts or ``GROUP_SHINGLES`` shingles are compared as pairs of blocks.

Defined results: null texts and texts without words have fingerprint zero and are linked with each other, also in
``near_duplicates`` and ``keep_one``, which know texts by their digest: a row goes only for its text, whatever its doc_id;
null doc_ids count as the largest;
equal texts are always linked; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release, text_or_empty

SEED, RADIUS = 42, 3
#: SHARD_POINTS: points that a task compares (some 10 CPU seconds, 1 MB); DEAL_POINTS: points that a task deals out at once.
SAMPLE, SHARD_POINTS, DEAL_POINTS, LEAF, CANDIDATES = 20_000, 65_536, 65_536, 256, 6
BANDS, ROWS, GROUP_BLOCK, GROUP_SHINGLES, FEW = 6, 2, 8192, 1 << 21, 8
#: Up to so many texts with a partner are told to the readers of the shingle sets, so that the others' sets stay where they are.
BROADCAST_NODES = 2_000_000


# --- fingerprints -------------------------------------------------------------------------------


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    # All shingles are slices of the words joined by one space.
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of every bit, as an unsigned number."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint_table(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, fp long")


# --- trees and components -----------------------------------------------------------------------


def distances(points: np.ndarray, to: int | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(to)).astype(np.int64)


def choose_split(points: np.ndarray, radius: int, rng) -> tuple[int, int] | None:
    """(vantage point, m) of the candidate whose sides are smallest; None where no split pays."""
    best = None
    for vantage in points[rng.integers(0, len(points), CANDIDATES)].tolist():
        far = np.bincount(distances(points, vantage), minlength=65).cumsum()
        for m in {int(np.searchsorted(far, len(points) // 2)), max(0, int(np.searchsorted(far, len(points) // 2)) - radius // 2)}:
            inside, outside = int(far[min(64, m + radius)]), len(points) - int(far[m])
            cost = inside**2 + outside**2
            if outside and inside < len(points) and (best is None or cost < best[0]):
                best = cost, vantage, m
    return None if best is None or best[0] > 0.95 * len(points) ** 2 else best[1:]


def grow(points: np.ndarray, radius: int, leaf: float, rng) -> list[tuple[int, int, int, int]]:
    """Tree nodes (vantage point, m, inside, outside); a child of -1 - s is leaf s."""
    nodes: list[list[int]] = []
    leaves = 0
    todo: list[tuple[np.ndarray, int, int]] = [(points, -1, 0)]
    while todo:
        part, parent, side = todo.pop()
        split = choose_split(part, radius, rng) if len(part) > leaf else None
        if split is None:
            ref, leaves = -1 - leaves, leaves + 1
        else:
            ref = len(nodes)
            nodes.append([split[0], split[1], 0, 0])
            d = distances(part, split[0])
            todo += [(part[d <= split[1] + radius], ref, 2), (part[d > split[1]], ref, 3)]
        if parent >= 0:
            nodes[parent][side] = ref
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indices of the points that go there)."""
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        ref, rows = todo.pop()
        if not len(rows):
            continue
        if ref < 0:
            yield -1 - ref, rows
            continue
        vantage, m, inside, outside = nodes[ref]
        d = distances(points[rows], vantage)
        todo += [(inside, rows[d <= m + radius]), (outside, rows[d > m])]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: the least index of each component."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, low = a[open_], b[open_], np.minimum(x, y)[open_]
        np.minimum.at(label, x[open_], low)
        np.minimum.at(label, y[open_], low)
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label = next_


def pair_blocks(points: np.ndarray, radius: int, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, each at least once; a tree down to small leaves, blocks beyond."""
    nodes = grow(points, radius, LEAF, np.random.default_rng(seed))
    for _, rows in route(points, nodes, radius):
        for a in range(0, len(rows), 1024):
            left = rows[a : a + 1024]
            for b in range(a, len(rows), 1024):
                right = rows[b : b + 1024]
                i, j = np.nonzero(np.bitwise_count(points[left][:, None] ^ points[right][None, :]) <= radius)
                near = left[i] < right[j] if a == b else slice(None)
                if len(i):
                    yield left[i][near], right[j][near]


def components(points: np.ndarray, radius: int) -> np.ndarray:
    label = np.arange(len(points))
    for i, j in pair_blocks(points, radius):
        label = merge_labels(label, i, j)
    return label


def is_star_forest(edges: DataFrame) -> bool:
    """Every node has one target, and no target is a node with a target."""
    many = edges.groupBy("u").count().where("count > 1").limit(1)
    chained = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").limit(1)
    return not many.unionByName(chained.withColumn("count", F.lit(0).cast("long"))).take(1)


def few_files(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` of a table of numbers behind a shuffle, in a file for each core at most: Hadoop starts processes for every local file, and
    tables of links are written round after round."""
    return materialize(df.coalesce(df.sparkSession.sparkContext.defaultParallelism), name)


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """u, v: each node with the least node of its component, which has no row itself. edges: u, v longs."""
    now = few_files(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        if is_star_forest(now):
            return now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = few_files(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = few_files(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        release(now)
        release(large)
        now = after
    raise RuntimeError("components did not settle")


STAR = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shard_trees(points: DataFrame, big: DataFrame, radius: int, most: int, turn: int) -> DataFrame:
    """shard, n, tree: a tree for each shard of ``big`` (shard, n), grown on about ``SAMPLE`` of its points; null where no split pays."""

    def plant(table: pa.Table) -> pa.Table:
        sample = np.unique(table["fp"].to_numpy()).view(np.uint64)
        n = table["n"][0].as_py()
        # Leaves are held somewhat below the bound, since the sample only tells their sizes roughly.
        nodes = grow(sample, radius, max(2, 0.8 * most * len(sample) / n), np.random.default_rng(SEED))
        return pa.table([table["shard"][:1], table["n"][:1], pa.array([json.dumps(nodes) if nodes else None], pa.string())], ["shard", "n", "tree"])

    rate = F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE)).cast("long")
    sample = points.join(big, "shard").where(F.pmod(F.xxhash64("fp", F.lit(SEED + turn)), rate) == 0)
    return sample.select("shard", "n", "fp").groupBy("shard").applyInArrow(plant, "shard long, n long, tree string")


def shards_of(points: DataFrame, radius: int, most: int | None = None) -> DataFrame:
    """shard, a, b, fp: shards of at most ``most`` points, or pairs of such blocks; every pair within the radius meets in one."""
    most = most or SHARD_POINTS
    placed, done, turn = points.select(F.lit(0).cast("long").alias("shard"), "fp"), [], 0

    def deal(key, rows: pa.Table, trees: pa.Table) -> pa.Table:
        fps = rows["fp"].to_numpy()
        nodes = json.loads(trees["tree"][0].as_py())
        got = list(route(fps.view(np.uint64), nodes, radius))
        shard = np.concatenate([np.full(len(r), xxhash.xxh64_intdigest(f"{key[0].as_py()}/{leaf}", SEED) - (1 << 63), np.int64) for leaf, r in got])
        return pa.table([pa.array(shard), pa.array(fps[np.concatenate([r for _, r in got])])], ["shard", "fp"])

    while True:
        sizes = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        big = materialize(sizes.where(F.col("n") > most), "simhash-big")
        if not big.take(1):
            return functools.reduce(DataFrame.unionByName, [placed.select("shard", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp"), *done])
        trees = materialize(shard_trees(placed, big, radius, most, turn), "simhash-trees")
        done.append(placed.join(big, "shard", "left_anti").select("shard", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp"))
        whole = trees.where("tree is null")
        if whole.take(1):
            blocks = F.ceil(F.col("n") / most).cast("int")
            dense = placed.join(whole.select("shard", blocks.alias("blocks")), "shard").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
            dense = dense.select("shard", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            done.append(dense.select("shard", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp"))
        slices = F.ceil(F.col("n") / DEAL_POINTS).cast("int")
        split = trees.where("tree is not null").withColumn("slices", slices)
        left = placed.join(split.select("shard", "slices"), "shard").withColumn("slice", F.pmod(F.xxhash64("fp", F.lit(turn)), F.col("slices")).cast("int"))
        right = split.select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "tree")
        placed = left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(deal, "shard long, fp long")
        placed, turn = materialize(placed, "simhash-shards"), turn + 1


def hamming_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: stars that connect all distinct ``fp`` values within the radius."""

    def shard(table: pa.Table) -> pa.Table:
        fps = np.unique(table["fp"].to_numpy())
        label = components(fps.view(np.uint64), radius)
        linked = np.flatnonzero(label != np.arange(len(fps)))
        return pa.table([pa.array(fps[linked]), pa.array(fps[label[linked]])], schema=STAR)

    return shards_of(points, radius).groupBy("shard", "a", "b").applyInArrow(shard, "u long, v long")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable by links of at most ``radius`` bits."""
    prints = materialize(fingerprint_table(docs, width), "fingerprints")
    points = few_files(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-points")
    stars = connected(hamming_links(points, radius))
    rooted = points.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(owner, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of shingle sets -----------------------------------------------------------------


def signature(text: bytes, width: int) -> tuple[bytes, int, int, bytes, list[int]]:
    """(digest of the text, fingerprint, set size, set, band keys)."""
    hashes = shingle_hashes(text, width)
    distinct = np.unique(hashes)
    print_ = fingerprint(distinct)
    bands = []
    if len(distinct):
        rng = np.random.default_rng(SEED)
        odd = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        least = [int(((distinct ^ (distinct >> np.uint64(29))) * m).min()) for m in odd]
        for b in range(BANDS):
            key = b"".join(x.to_bytes(8, "little") for x in least[b * ROWS : (b + 1) * ROWS]) + bytes([b])
            bands.append(xxhash.xxh64_intdigest(key, SEED) - (1 << 63))
    return hashlib.md5(text).digest(), print_, len(distinct), distinct.astype("<u8").tobytes(), bands


def signature_table(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                got = [signature(t.as_py(), width) for t in part.column(1)]
                digest, fp, n, held, bands = zip(*got)
                yield pa.record_batch(
                    [part.column(0), pa.array(digest, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(held, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "digest", "fp", "n", "shingles", "bands"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, digest binary, fp long, n long, shingles binary, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches ``least``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def group_links(ids: np.ndarray, fps: np.ndarray, sizes: np.ndarray, held: list[bytes], least: float) -> list[tuple[int, int]]:
    """Stars of the components in one partition."""
    first: dict[bytes, int] = {}
    out, rows = [], []
    for i in np.lexsort((ids, sizes)).tolist():
        at = first.setdefault(held[i], i)
        if at == i:
            rows.append(i)
        elif ids[at] != ids[i]:
            out.append((int(ids[i]), int(ids[at])))
    ids, fps, sizes = ids[rows], fps[rows], sizes[rows]
    sets = [np.frombuffer(held[i], "<u8") for i in rows]
    label = np.arange(len(rows))
    for x, y in (few_pairs if len(rows) <= FEW else similar_pairs)(sets, sizes, fps, least, label):
        low, high = sorted((label[x], label[y]))
        label[label == high] = low
    return out + [(int(ids[x]), int(ids[label[x]])) for x in np.flatnonzero(label != np.arange(len(rows)))]


def few_pairs(sets, sizes, fps, least, label) -> Iterator[tuple[int, int]]:
    """Similar pairs that have different labels when they are met."""
    for y in range(len(sets)):
        for x in range(y):
            if label[x] != label[y] and sizes[x] >= least * sizes[y] - 1e-9 and similar(sets[x], sets[y], least):
                yield x, y


def similar_pairs(sets, sizes, fps, least, label) -> Iterator[tuple[int, int]]:
    """The same for many sets, in ascending order of size: similar ones share one of their rarest shingles."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(count), np.int64)
    rarity[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rarity[token]
    heads = [np.sort(token[a:b])[: b - a - int(np.ceil(least * (b - a) - 1e-9)) + 1] for a, b in zip(starts, ends)]
    owner = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
    flat = np.concatenate(heads)
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    edges = np.searchsorted(flat[order], np.arange(len(count) + 1))
    seen, mark = np.zeros(len(sets), bool), np.zeros(len(count), bool)
    for y in range(1, len(sets)):
        low = int(np.searchsorted(sizes, least * sizes[y] - 1e-9))
        head = heads[y][edges[heads[y] + 1] - edges[heads[y]] > 1]
        if low >= y or not len(head):
            continue
        for a, b in zip(edges[head].tolist(), edges[head + 1].tolist()):
            seen[owner[a:b]] = True
        near = np.flatnonzero(seen[low:y]) + low
        seen[:] = False
        near = near[label[near] != label[y]]
        near = near[np.argsort(np.bitwise_count(fps[near] ^ fps[y]), kind="stable")]
        mark[token[starts[y] : ends[y]]] = True
        while len(near):
            for at, x in enumerate(near.tolist()):
                both = np.count_nonzero(mark[token[starts[x] : ends[x]]])
                if both >= least * (sizes[x] + sizes[y] - both) - 1e-9:
                    yield x, y
                    break
            near = near[at + 1 :]
            near = near[label[near] != label[y]]
        mark[token[starts[y] : ends[y]]] = False


def clustered(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes (node, fp, n, bands) with cluster: the fingerprint that names the node's component under links of at most ``radius`` bits."""
    nodes = materialize(nodes, "signature-nodes")
    stars = connected(hamming_links(nodes.select("fp").distinct(), radius))
    return nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("cluster", F.coalesce("root", "fp")).drop("root")


def partitions(nodes: DataFrame) -> DataFrame:
    """node, way, key, a, b: the partitions whose pairs are compared, or pairs of such blocks. nodes: node, n, cluster, bands.

    Way 0 are the fingerprints' components. Way 1 are pairs of min-wise shingles, for similar texts whose fingerprints lie further apart: only
    those that hold texts of more than one component, since every pair of one component already meets there."""
    nodes = materialize(nodes.select("node", "n", "cluster", "bands"), "signature-clusters")
    by = lambda way, key: F.struct(F.lit(way).alias("way"), key.alias("key"))
    keys = F.concat(F.array(by(0, F.col("cluster"))), F.transform("bands", lambda x: by(1, x)))
    keyed = nodes.select("node", "n", "cluster", F.explode(keys).alias("at")).select("node", "n", "cluster", "at.way", "at.key")
    held = keyed.groupBy("way", "key").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("shingles"), F.min("cluster").alias("least"), F.max("cluster").alias("most"))
    held = held.where("held > 1 AND (way = 0 OR least <> most)")
    blocks = F.least(F.col("held"), F.ceil(F.greatest(F.col("held") / GROUP_BLOCK, F.col("shingles") / GROUP_SHINGLES))).cast("int")
    asked = keyed.join(held.select("way", "key", blocks.alias("blocks")), ["way", "key"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    asked = asked.select("node", "way", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return asked.select("node", "way", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))


def similar_texts(docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, same and more of every document; same, first, root of every text). Texts of one root are one group."""
    same = F.when(F.col("n") > 0, F.col("digest")).otherwise(F.lit(b""))
    signed = materialize(signature_table(docs, width).withColumn("node", F.monotonically_increasing_id()).withColumn("same", same), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "node")
    points = materialize(signed.groupBy("same").agg(F.min(first).alias("first")), "signature-points")
    nodes = signed.join(points.select(F.col("first.node").alias("node")), "node", "left_semi").where("n > 0").select("node", "fp", "n", "bands")
    asked = materialize(partitions(clustered(nodes)), "signature-partitions")
    needed = asked.select("node").distinct()
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_NODES else needed
    carried = asked.join(signed.select("node", "fp", "n", "shingles").join(needed, "node", "left_semi"), "node")

    def link(table: pa.Table) -> pa.Table:
        got = group_links(table["node"].to_numpy(), table["fp"].to_numpy().view(np.uint64), table["n"].to_numpy(), table["shingles"].to_pylist(), similarity)
        return pa.table([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], schema=STAR)

    stars = connected(carried.groupBy("way", "key", "a", "b").applyInArrow(link, "u long, v long"))
    rooted = points.withColumn("node", F.col("first.node")).join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    return signed, rooted.select("same", "first", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id for every document: the smallest doc_id of its group."""
    signed, rooted = similar_texts(docs, width, similarity)
    least = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    return signed.join(rooted.join(least, "root").select("same", "component_id"), "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group one stays, that with the smallest doc_id (then digest of the text)."""
    signed, rooted = similar_texts(docs, width, similarity)
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    kept = materialize(least.select(F.col("first.doc_id").alias("_kept_id"), F.col("first.digest").alias("_kept_digest")), "kept-ids")
    rows = docs.withColumn("_digest", F.unhex(F.md5(text_or_empty().cast("binary"))))
    out = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest")), "left_semi")
    repeated = signed.groupBy("doc_id", "digest").count().where("count > 1").take(1)
    release(signed)
    return (out.dropDuplicates(["doc_id", "_digest"]) if repeated else out).select(*docs.columns)
