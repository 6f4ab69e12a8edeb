"""Operator 3: SimHash near-duplicates through the generalised pigeonhole principle."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored
from .components import components

BITS = 64
#: Buckets of more fingerprints than this are linked through shared one-bit neighbours rather than by pairs.
PAIR_LIMIT = 64


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: unsigned, 0 for a text without words."""
    import xxhash

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(ws) - size + 1
    if not ws:
        return 0
    shingles = [b" ".join(ws)] if n < 1 else list(map(b" ".join, zip(*(ws[k : n + k] for k in range(size)), strict=True)))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), dtype="<u8", count=len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), dtype="<u8", count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("<i8"))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set; 64 x 64 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(v), 1 << 16):
                bits = np.unpackbits(np.ascontiguousarray(v[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([n, *map(int, both.ravel())], pa.int64())], names=["k", "n"])

    sums = dict(fps.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect())
    return sums.get(0, 0), np.array([sums.get(k + 1, 0) for k in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)


def even_sizes(m: int) -> list[int]:
    return [BITS // m + (g < BITS % m) for g in range(m)]


def correlated_groups(n: int, both: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Groups of the 64 bits of the given sizes, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    phi = np.abs((both / max(n, 1) - np.outer(p, p)) / np.maximum(np.outer(spread, spread), 1e-9))
    np.fill_diagonal(phi, 0)
    free, groups = set(range(BITS)), []
    for size in sizes:
        rest = sorted(free)
        group = [max(rest, key=lambda i: (phi[i, rest].max(), -i))]
        while len(group) < size:
            group.append(max((i for i in rest if i not in group), key=lambda i: (phi[i, group].mean(), -i)))
        free -= set(group)
        groups.append(sorted(group))
    return groups


def allotted(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one a group, that sum to total at the least cost; cost[i][t + 1] is that of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for had, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if had + t not in step or c + x < step[had + t][0]:
                    step[had + t] = (c + x, [*ts, t])
        best = step
    return best[total]


def packed(fp: Column, bits: list[int]) -> Column:
    """The given bits of fp as one long."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def flips(width: int, radius: int) -> list[int]:
    """All masks of up to radius bits below width, as signed longs."""
    out, last = {0}, {0}
    for _ in range(max(radius, 0)):
        last = {x ^ (1 << b) for x in last for b in range(width)}
        out |= last
    return sorted(x - (1 << 64) if x >= 1 << 63 else x for x in out)


def plan(fps: DataFrame, within: int) -> list[tuple[list[int], int]]:
    """Groups of bits with the radius to probe each at: fingerprints within the distance agree in one group to its radius."""
    n, both = bit_counts(fps)
    options = [correlated_groups(n, both, even_sizes(m)) for m in range(2, within + 3)]
    groups = [(i, g) for i, groups in enumerate(options) for g in groups]
    values = F.array(*[F.struct(F.lit(k).alias("k"), packed(F.col("fp"), g).alias("v")) for k, (_, g) in enumerate(groups)])
    sizes = fps.select(F.inline(values)).groupBy("k", "v").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum(F.col("c").cast("double") * F.least("c", F.lit(PAIR_LIMIT))).alias("pairs"))
    pairs = dict(sizes.collect())
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    best = (math.inf, [])
    for i, option in enumerate(options):
        cost = []
        for k, g in [(k, g) for k, (j, g) in enumerate(groups) if j == i]:
            tails, row = np.zeros(within + 1), [0.0]
            tails[0] = 1.0
            for b in g:  # share of pairs that differ in t of the bits, from the single bits' shares
                tails = tails * agree[b] + np.concatenate([[0.0], tails[:-1]]) * (1 - agree[b])
            for t in range(within + 1):
                row.append(pairs.get(k, 0.0) * tails[: t + 1].sum() / max(tails[0], 1e-300) + n * len(flips(len(g), t)))
            cost.append(row)
        c, ts = allotted(cost, within - len(option) + 1)
        if c < best[0]:
            best = (c, [(g, t) for g, t in zip(option, ts, strict=True) if t >= 0])
    return best[1]


def links(fps: DataFrame, within: int) -> DataFrame:
    """Edges (a, b) that connect exactly what fingerprints within the distance of two connect.

    Small buckets give their verified pairs. A bucket over PAIR_LIMIT gives no pairs: its fingerprints and all
    that probe it are tied to the values one bit away, for two fingerprints differ in at most two bits just when
    they share such a value. So rows stay in proportion to fingerprints, however large a bucket.
    """
    if within != 2:
        raise ValueError("within must be 2")
    parts = plan(fps, within)
    index = stored(fps.select("fp", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), packed(F.col("fp"), g).alias("v")) for k, (g, _) in enumerate(parts)]))))
    sizes = index.groupBy("k", "v").agg(F.count("*").alias("c"))
    hot = sizes.where(F.col("c") > PAIR_LIMIT).select("k", "v")
    shared = sizes.where(F.col("c") <= PAIR_LIMIT).select("k", "v")
    probes = index.where(F.col("k").isin([k for k, (_, t) in enumerate(parts) if t == 0]))
    for k, (g, t) in enumerate(parts):
        if t > 0:
            probes = probes.unionByName(index.where(F.col("k") == k).select("fp", "k", F.explode(F.transform(F.array(*map(F.lit, flips(len(g), t))), lambda x: F.col("v").bitwiseXOR(x.cast("long")))).alias("v")))
    a = index.join(shared, ["k", "v"]).select("k", "v", F.col("fp").alias("a"))
    pairs = a.join(probes.select("k", "v", F.col("fp").alias("b")), ["k", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= within)).select("a", "b")
    crowd = probes.join(hot, ["k", "v"], "left_semi").select("fp").unionByName(index.join(hot, ["k", "v"], "left_semi").select("fp")).distinct()
    near = F.array(*map(F.lit, flips(BITS, within - 1)))
    hubs = crowd.select("fp", F.explode(F.transform(near, lambda x: F.col("fp").bitwiseXOR(x.cast("long")))).alias("hub"))
    low = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count("*").alias("c")).where("c > 1")
    ties = hubs.join(low.select("hub", "a"), "hub").where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(ties)


def near_duplicates(docs: DataFrame, size: int = 3, within: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id of each document.

    Input: doc_id, text; other columns are not read. Null and empty texts have fingerprint zero and link like any
    other. Copies meet in one row before any join, so a group of copies costs one row. Repeated rows each give a
    row; a null doc_id counts only in a component without other ids. Empty tables give no rows.
    """
    own = stored(fingerprints(docs, size))
    fps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp"), within))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For a similarity, so many 64-bit words are drawn from each shingle; the words together tell it to within 0.02.
WORDS = 24
BY_CHANCE = 4
#: Pairs pass on to their texts if they differ in up to so many standard errors more bits than the similarity gives.
LEEWAY = 3
#: Pairs just at the similarity are candidates with this probability at least, however many texts there are.
RECALL = 0.95
#: Buckets of at most this many texts are compared in one task, where they name all pairs up to so many a text, else the
#: nearest others of each.
TASK_LIMIT, MANY, NEAREST = 2000, 32, 4
#: Larger buckets are parted by so many further bits at a time, in ways that keep this share of the pairs just at the
#: similarity, up to so many times.
SPLIT_BITS, SPLIT_RECALL, LEVELS = 8, 0.99, 3
#: Partitions of the (word, bit) places, each with its radius.
Parts = list[tuple[list[tuple[int, int]], int]]
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(text: str | None, size: int) -> set[bytes]:
    """The word shingles of a text; a shorter text is one itself, one without words has none."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(ws) - size + 1
    if n < 1:
        return {b" ".join(ws)} if ws else set()
    return set(map(b" ".join, zip(*(ws[k : n + k] for k in range(size)), strict=True)))


def wide_fingerprint(text: str | None, size: int, words: int = WORDS) -> np.ndarray:
    """The SimHash of a text's set of shingles over words * 64 bits, as unsigned words."""
    import xxhash

    shingles = shingle_set(text, size)
    if not shingles:
        return np.zeros(words, dtype="<u8")
    steps = np.arange(1, words + 1, dtype=np.uint64) * MIX[0]
    ones = np.zeros(words * BITS, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=len(shingles))
    for at in range(0, len(h), 255):
        x = h[at : at + 255, None] + steps
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def wide_fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text digest (hex) and the wide fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            fps = np.stack([wide_fingerprint(t, size) for t in texts]).view("<i8") if texts else np.zeros((0, WORDS), "<i8")
            digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()[:32] for t in texts]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * WORDS + 1, WORDS, dtype=np.int32)), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.string()), flat], names=["doc_id", "digest", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, digest string, fp array<long>")


def farthest(similarity: float) -> int:
    """How many of all bits may differ at a Jaccard similarity of shingle sets, by the angle between their vectors, and LEEWAY."""
    p, n = math.acos(2 * similarity / (1 + similarity)) / math.pi, WORDS * BITS
    return int(p * n + LEEWAY * math.sqrt(p * (1 - p) * n))


def wide_width(n: int) -> int:
    """The bits of a partition: some BY_CHANCE more than it takes to number n texts, so that few meet by chance."""
    return max(8, min(BITS, math.ceil(math.log2(max(n, 2))) + BY_CHANCE))


def found(width: int, count: int, similarity: float) -> float:
    """The probability that a pair of the similarity agrees in one of so many partitions drawn from all bits.

    Partitions share bits, so what a pair's number of differing bits does to all of them is averaged over that number.
    """
    total = WORDS * BITS
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    differ = np.arange(total + 1)
    weight = np.exp(-((differ - p * total) ** 2) / (2 * max(p * (1 - p) * total, 1e-9)))
    agree = np.prod([np.maximum(total - differ - i, 0) / (total - i) for i in range(width)], axis=0)
    return float(1 - (weight * (1 - agree) ** count).sum() / weight.sum())


def partition_count(n: int, similarity: float) -> int:
    """How many partitions find pairs of the similarity among n texts with probability RECALL."""
    width, low, high = wide_width(n), 0, WORDS * BITS // wide_width(n)
    while found(width, high, similarity) < RECALL:
        low, high = high, 2 * high
    while low + 1 < high and high > WORDS * BITS // width:
        mid = (low + high) // 2
        low, high = (low, mid) if found(width, mid, similarity) >= RECALL else (mid, high)
    return high


def drawn_places(count: int, width: int, seed: int = 0) -> list[list[tuple[int, int]]]:
    """So many partitions of all bits, drawn anew after each round of disjoint ones."""
    rng, out = np.random.default_rng(42 + seed), []
    while len(out) < count:
        order = rng.permutation(WORDS * BITS)
        out += [[(int(x) // BITS, int(x) % BITS) for x in order[k : k + width]] for k in range(0, len(order) - width + 1, width)]
    return out[:count]


def wide_plan(fps: DataFrame, similarity: float) -> Parts:
    """Partitions of the (word, bit) places, each with its radius.

    First come disjoint ones, correlated places together; as the width grows with the texts, others are drawn from all
    places until pairs of the similarity are found with probability RECALL. Radii come from the dynamic programme,
    three partitions at a time.
    """
    counted = bit_counts_by_word(fps)
    n = counted[0][0]
    width = wide_width(n)
    places: list[list[tuple[int, int]]] = []
    spare: list[tuple[int, int]] = []
    shares = {}
    for j, (_, both) in enumerate(counted):
        groups = correlated_groups(n, both, [width] * (BITS // width))
        places += [[(j, b) for b in g] for g in groups]
        spare += [(j, b) for b in range(BITS) if not any(b in g for g in groups)]
        p = np.diag(both) / max(n, 1)
        shares.update({(j, b): x for b, x in enumerate(p * p + (1 - p) * (1 - p))})
    places += [spare[k : k + width] for k in range(0, len(spare) - width + 1, width)]
    places += drawn_places(partition_count(n, similarity) - len(places), width)
    out = []
    for k in range(0, len(places), 3):
        cost = []
        for g in places[k : k + 3]:
            agree = np.array([shares[x] for x in g])
            cost.append([0.0, *(float(n) * n * np.prod(agree) * (1 + t * ((1 - agree) / agree).sum()) + n * len(flips(len(g), t)) for t in (0, 1))])
        out += [(g, t) for g, t in zip(places[k : k + 3], allotted(cost, 0)[1], strict=True) if t >= 0]
    return out


def part_values(words: np.ndarray, k: int, places: list[tuple[int, int]]) -> np.ndarray:
    """The bits of partition k of fingerprints whose words are in rows, told apart from other partitions' by bits of its own."""
    v = np.full(words.shape[1], (k + 1) * int(MIX[0]) % (1 << 64), dtype=np.uint64)
    for i, (j, bit) in enumerate(places):
        v ^= (words[j] >> np.uint64(bit) & np.uint64(1)) << np.uint64(i)
    return v


def partitioned(fps: DataFrame, parts: Parts) -> DataFrame:
    """node, part, key: the bucket of each node in each partition, and those within the partition's radius.

    Where two partitions share a key all the same, that only adds candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = fp_words(b.column(1)).T.copy()
            node = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(parts), 16):
                nodes, of, keys = [], [], []
                for k, (places, radius) in enumerate(parts[at : at + 16], at):
                    v = part_values(words, k, places)
                    for mask in flips(len(places), radius):
                        nodes.append(node)
                        of.append(np.full(len(node), k, dtype=np.int32))
                        keys.append(v ^ np.uint64(mask % (1 << 64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(of)), pa.array(np.concatenate(keys).view(np.int64))], names=["node", "part", "key"])

    return fps.select("node", "fp").mapInArrow(run, "node long, part int, key long")


def similar_links(fps: DataFrame, similarity: float, texts: Callable[[DataFrame], DataFrame] | None = None, size: int = 5) -> DataFrame:
    """Edges (a, b) that connect what pairs of candidates connect that are as similar as asked.

    First each text meets the least node of its bucket; this joins groups of copies however large, and settles buckets
    of two. Left are buckets where other members are still apart. There each text names those near it by fingerprint
    that it is not connected to. A bucket with more than MANY such pairs a text names only the NEAREST ones of each and
    comes again, with what is connected by then and a higher limit, until it has named all.
    Candidates whose wide fingerprints are near enough are settled by the shingles of their texts, which texts() gives
    as (node, text) for a table of nodes; without it the fingerprints decide. Pairs that differ in fewer bits than there
    are disjoint partitions are sure to be candidates.
    """
    n_bits = farthest(similarity)
    parts = wide_plan(fps, similarity)
    index = partitioned(fps, parts)
    sizes = stored(index.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("lead"), F.max("node").alias("last")).where("c > 1"))
    crowd = stored(index.join(sizes.where("c > 2").select("key", "lead"), "key").where("node <> lead"))
    pairs = lambda d, a, b: d.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    tried = stored(pairs(sizes.where("c = 2").select("lead", F.col("last").alias("node")).unionByName(crowd.select("lead", "node")), "lead", "node"))
    near = stored(verified(tried, fps, n_bits))
    known = stored(texts(near.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowd.select("node")).distinct())) if texts else None
    out = near if known is None else stored(alike(near, known, similarity, size))
    roots = stored(components(out))
    rows, split = apart(crowd.select("key", "part", "node"), roots, fps, similarity)
    most = MANY
    while True:
        met = stored(nearest(rows, split, fps, parts, n_bits, most))
        named = stored(pairs(met.where("left IS NULL"), "a", "b").join(tried, ["a", "b"], "left_anti"))
        links = named if known is None else stored(alike(named, known, similarity, size))
        out = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
        left = met.where("left IS NOT NULL").select(F.col("left").alias("key")).distinct()
        if not left.head(1):
            dropped(sizes)
            return out
        tried, most, roots = tried.unionByName(named), 4 * most, stored(components(out))
        rows = opened(rooted(rows.join(left, "key"), roots))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (key, part, node) with the root of each node, itself if it has none.

    A text is in as many buckets as there are partitions, so roots meet texts, a row each, and not their buckets.
    """
    texts = rows.groupBy("node").agg(F.collect_list(F.struct("key", "part")).alias("at")).join(roots, "node", "left")
    return texts.select(F.inline("at"), "node", F.coalesce("root", "node").alias("root"))


def opened(rows: DataFrame) -> DataFrame:
    """rows (key, part, node, root) of buckets that hold two roots, with the size c of the bucket.

    The rows are read twice and stored for that, so that they are made once.
    """
    rows = stored(rows.select("key", "part", "node", "root"))
    two = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "c")
    out = stored(rows.join(two, "key"))
    dropped(rows)
    return out


def apart(crowd: DataFrame, roots: DataFrame, fps: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """key, part, node, root of buckets of at most TASK_LIMIT members that are not all connected; node, part of larger ones.

    Larger buckets are parted by further bits, in as many ways as find pairs of the similarity with probability
    SPLIT_RECALL, up to LEVELS times; what is large even then goes out in pairs of blocks, which meet every pair.
    """
    columns = ["key", "part", "node", "root"]
    rows = opened(rooted(crowd, roots))
    out, large = rows.where(F.col("c") <= TASK_LIMIT), rows.where(F.col("c") > TASK_LIMIT)
    split = large.select("node", "part")
    for level in range(LEVELS):
        if not large.head(1):
            return out.select(columns), split
        rows = opened(subdivided(large, fps, level, similarity))
        out, large = out.unionByName(rows.where(F.col("c") <= TASK_LIMIT)), rows.where(F.col("c") > TASK_LIMIT)
    n = F.ceil(F.col("c") / TASK_LIMIT).cast("int")
    dealt = large.withColumn("i", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), n - 1)))
    blocks = dealt.withColumn("key", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")))
    return out.select(columns).unionByName(blocks.select(columns)), split


def subdivided(rows: DataFrame, fps: DataFrame, level: int, similarity: float) -> DataFrame:
    """rows (key, part, node, root) under the keys of parts of their buckets: one a row for each drawn group of SPLIT_BITS bits."""
    count = 1
    while found(SPLIT_BITS, count, similarity) < SPLIT_RECALL:
        count += 1
    places = drawn_places(count, SPLIT_BITS, level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = fp_words(b.column(4)).T.copy()
            key = b.column(0).to_numpy(zero_copy_only=False).view("<u8")
            for k, group in enumerate(places):
                v = np.full(len(key), k + 1, dtype=np.uint64)
                for j, bit in group:
                    v = v << np.uint64(1) | (words[j] >> np.uint64(bit) & np.uint64(1))
                v = (key ^ (v * MIX[0])) * MIX[1]
                yield pa.RecordBatch.from_arrays([pa.array((v ^ (v >> np.uint64(31))).view(np.int64)), *b.columns[1:4]], names=["key", "part", "node", "root"])

    return rows.join(fps, "node").select("key", "part", "node", "root", "fp").mapInArrow(run, "key long, part int, node long, root long")


def nearest(rows: DataFrame, split: DataFrame, fps: DataFrame, parts: Parts, n_bits: int, most: int) -> DataFrame:
    """Pairs (a, b) of one bucket and different roots within so many bits; left is the key of a bucket that has more than most a text.

    A pair that meets in several buckets is written out in the first partition only, unless that bucket was parted.
    """

    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("left", pa.int64())])

    def met_before(part: int, fp: np.ndarray, parted: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=bool)
        for p in range(part if len(i) else 0):
            v = part_values(fp.T, p, parts[p][0])
            out |= (v[i] == v[k]) & ~parted[i, p]
        return out

    def near(root: np.ndarray, fp: np.ndarray, nearest_only: bool) -> tuple[np.ndarray, np.ndarray]:
        one, two = [], []
        for at in range(0, len(root), 64):
            far = np.zeros((min(64, len(root) - at), len(root)), dtype=np.uint16)
            for j in range(WORDS):
                far += np.bitwise_count(fp[at : at + 64, j, None] ^ fp[None, :, j])
            far[root[at : at + 64, None] == root] = np.iinfo(np.uint16).max
            hit = far <= n_bits
            if nearest_only and NEAREST < len(root):
                hit &= far <= np.partition(far, NEAREST - 1, axis=1)[:, NEAREST - 1 : NEAREST]
            i, k = np.nonzero(hit)
            one.append(at + i)
            two.append(k)
        return np.concatenate(one), np.concatenate(two)

    def of_bucket(key: int, part: int, node: np.ndarray, root: np.ndarray, fp: np.ndarray, parted: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, k = near(root, fp, False)  # both ways
        if len(i) > 2 * most * len(node):
            i, k = near(root, fp, True)
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([key])], schema=kinds)
        pair = np.unique(np.minimum(i, k).astype(np.int64) * len(node) + np.maximum(i, k))
        for at in range(0, len(pair), 1 << 17):
            i, k = np.divmod(pair[at : at + (1 << 17)], len(node))
            new = ~met_before(part, fp, parted, i, k)
            x, y = node[i[new]], node[k[new]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64())], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in itertools.chain(batches, [None]):
            if b is not None and b.num_rows:
                parted = np.zeros((b.num_rows, len(parts)), dtype=bool)
                for r, ps in enumerate(b.column(5).to_pylist()):
                    parted[r, ps or []] = True
                held.append((*(b.column(k).to_numpy(zero_copy_only=False) for k in range(4)), fp_words(b.column(4)), parted))
            if not held or (b is not None and len(held) > 1 and held[-1][0][-1] == held[0][0][0]):
                continue
            key, part, node, root, fp, parted = (np.concatenate(x) for x in zip(*held, strict=True))
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            if b is not None:
                edges.pop()  # the last bucket may go on in the next batch
            for s, e in itertools.pairwise(edges):
                yield from of_bucket(int(key[s]), int(part[s:e].min()), node[s:e], root[s:e], fp[s:e], parted[s:e])
            held = [tuple(x[edges[-1] :] for x in (key, part, node, root, fp, parted))] if b is not None else []

    parted = split.groupBy("node").agg(F.collect_set("part").alias("parted"))
    dealt = rows.join(fps.join(parted, "node", "left"), "node").select("key", "part", "node", "root", "fp", "parted").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long, left long")


def fp_words(column: pa.Array) -> np.ndarray:
    """The unsigned words of a column of wide fingerprints, a row each."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype("<i8")).view("<u8").reshape(-1, WORDS)


def verified(pairs: DataFrame, fps: DataFrame, n_bits: int) -> DataFrame:
    """The pairs that differ in at most so many bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (fp_words(b.column(k)) for k in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= n_bits))

    one = fps.select(F.col("node").alias("a"), F.col("fp").alias("fa"))
    two = fps.select(F.col("node").alias("b"), F.col("fp").alias("fb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def alike(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs whose sets of shingles have at least the Jaccard similarity; texts without words are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, set()
        for b in batches:
            keep = []
            for node, ta, tb in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                x = shingle_set(ta.as_py(), size)
                if node != last:
                    last, y = node, shingle_set(tb.as_py(), size)
                both = len(x & y)
                either = len(x) + len(y) - both
                keep.append(not either or both / either >= similarity)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def bit_counts_by_word(fps: DataFrame) -> list[tuple[int, np.ndarray]]:
    """bit_counts of each word of wide fingerprints, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((WORDS, BITS, BITS))
        for b in batches:
            v = np.ascontiguousarray(b.column(0).flatten().to_numpy(zero_copy_only=False).astype("<i8")).reshape(-1, WORDS)
            n += len(v)
            for at in range(0, len(v), 1 << 14):
                for j in range(WORDS):
                    bits = np.unpackbits(np.ascontiguousarray(v[at : at + (1 << 14), j]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                    both[j] += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(both.size + 1), pa.int32()), pa.array([n, *map(int, both.ravel())], pa.int64())], names=["k", "n"])

    sums = fps.select("fp").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(WORDS * BITS * BITS + 1)
    flat[sums["k"].to_numpy()] = sums["n"].to_numpy()
    return [(int(flat[0]), x) for x in flat[1:].reshape(WORDS, BITS, BITS)]


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, one for each group of texts alike in their word shingles by at least the similarity.

    Kept is the row with the least doc_id of its group (rows without one come last, equal rows leave one; of rows that
    share id and text, the one whose other columns have the least hash). Texts that are the same meet in one row before any join. Null and empty texts are alike and leave one. Columns pass
    unchanged whatever their names; empty tables give no rows.
    """
    own = stored(wide_fingerprints(docs, size))
    fps = stored(own.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first"), F.min("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()))
    text_of = lambda d: F.coalesce(d["text"].cast("string"), F.lit(""))
    digest = F.substring(F.sha2(text_of(docs).cast("binary"), 256), 1, 32).alias("_digest")
    doc_id = F.coalesce(docs["doc_id"].cast("string"), F.lit("\0")).alias("_id")

    def texts(nodes: DataFrame) -> DataFrame:
        wanted = fps.join(nodes, "node", "left_semi").select(F.col("digest").alias("_digest"), F.coalesce(F.col("first.id").cast("string"), F.lit("\0")).alias("_id"), "node")
        return docs.select(digest, doc_id, text_of(docs).alias("text")).join(wanted, ["_digest", "_id"]).groupBy("_digest", "_id", "node").agg(F.min("text").alias("text")).select("node", "text")

    roots = components(similar_links(fps.select("node", "fp"), similarity, texts, size))
    named = fps.join(roots, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    kept = named.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("x")).select(F.col("x.digest").alias("_digest"), F.coalesce(F.col("x.first.id").cast("string"), F.lit("\0")).alias("_id"))
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name != "text" and f.dataType.typeName() not in ("map", "variant")]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(*others).alias("_hash"), digest, doc_id)
    one = marked.join(kept, ["_digest", "_id"], "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy("_digest", "_id").orderBy("_hash")))
    return one.where("_k = 1").select("_row.*")
