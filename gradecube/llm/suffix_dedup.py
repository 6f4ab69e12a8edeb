"""Operator 5: repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first SIZE bytes, by passes from the most significant digit on; what is alone
in its group drops out of all later passes, and the groups left after the last pass are exactly the repeated strings.
Digits are eight bytes of the suffix, compared as they are.

Before that, suffixes are dealt out so that equal ones meet. A suffix goes with its minimizer: the least hash among the
GRAM-byte strings of its first SIZE bytes, which equal suffixes share, so none is lost. Adjacent suffixes that share a
minimizer move as one run, a row for some 85 of them. Runs whose minimizer is alone drop out. Where the whole
neighbourhood in which every suffix with that minimizer ends occurs again, all of the run's strings do; neighbourhoods
are told apart by the hashes of minimizer and neighbourhood, 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freed, stored

SIZE, GRAM = 200, 32
#: Minimizers with more distinct neighbourhoods than this are told apart by a shuffle of their suffixes, not in one
#: task; at this limit a task holds some 3 MB of bytes and 30 MB of digits and places.
GROUP_LIMIT = 8000
PLACE_BITS = 20
MASK = np.uint64((1 << PLACE_BITS) - 1)
CHUNK = 1 << 17
TABLES = np.random.default_rng(7).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def grams(x: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each size-byte string of x, by the first or the second of two polynomials."""
    power = lambda n: np.uint64(pow(BASES[which], n, 1 << 64))
    h, width = TABLES[which][x], 1
    out, done = None, 0
    while True:
        if size & width:
            out, done = (h, width) if out is None else (out[: len(x) - done - width + 1] * power(width) + h[done:], done + width)
            if done == size:
                return out
        h, width = h[:-width] * power(width) + h[width:], 2 * width


def least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each span consecutive values."""
    width = 1
    while 2 * width <= span:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return x if width == span else np.minimum(x[: width - span], x[span - width :])


def minimizers(data: bytes, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of suffixes with one minimizer: its place, its hash, the first and the last suffix."""
    n, found = len(data) - size + 1, []
    x = np.frombuffer(data, dtype=np.uint8)
    for base in range(0, n, CHUNK):
        end = min(base + CHUNK, n)
        h = grams(x[base : end - 1 + size], gram)
        at = (least((h & ~MASK) | np.arange(len(h), dtype=np.uint64), size - gram + 1) & MASK).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        found.append((at[starts] + base, h[at[starts]], starts + base, np.concatenate([starts[1:] - 1, [end - base - 1]]) + base))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    a, h, s, e = (np.concatenate(v) for v in zip(*found, strict=True))
    new = np.concatenate([[True], a[1:] != a[:-1]])  # a run may cross from one chunk to the next
    return a[new], h[new], s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]


def text_key(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def runs_of(texts: DataFrame, size: int, gram: int) -> DataFrame:
    """The runs of each text: kh (first digit), uh (second; null where the text ends within it), key, a, s, e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["kh", "uh", "key", "a", "s", "e"]
        left = size - gram

        def batch(parts: list) -> pa.RecordBatch:
            cols = [np.concatenate(v) for v in zip(*[p[:4] for p in parts], strict=True)]
            keys = pa.array([p[4] for p in parts], pa.binary()).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])))
            uh = pa.array([x for p in parts for x in p[5]], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(cols[1].view(np.int64)), uh, keys, *(pa.array(cols[k].astype(np.int32)) for k in (0, 2, 3))], names=names)

        parts: list = []
        total = 0
        for b in batches:
            for t in b.column(0):
                data = t.as_py()
                if data is None or len(data) < size:
                    continue
                a, h, s, e = minimizers(data, size, gram)
                wide = [(xxhash.xxh3_64_intdigest(data[p - left : p + size]) ^ 1 << 63) - (1 << 63) if p >= left and p + size <= len(data) else None for p in a.tolist()]
                parts.append((a, h, s, e, text_key(data), wide))
                total += len(a)
                if total > 50_000:
                    yield batch(parts)
                    parts, total = [], 0
        if parts:
            yield batch(parts)

    return texts.select("data").mapInArrow(run, "kh long, uh long, key binary, a int, s int, e int")


def cut_out(texts: DataFrame, size: int) -> DataFrame:
    """kh, key, s and the bytes of each run listed beside a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kh, key, at, cut = [], [], [], []
            for i in range(b.num_rows):
                data, k = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for r in b.column(2)[i].as_py():
                    kh.append(r["kh"])
                    key.append(k)
                    at.append(r["s"])
                    cut.append(data[r["s"] : r["e"] + size])
                if len(kh) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(kh, pa.int64()), pa.array(key, pa.binary()), pa.array(at, pa.int32()), pa.array(cut, pa.binary())], names=["kh", "key", "s", "cut"])
                    kh, key, at, cut = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(kh, pa.int64()), pa.array(key, pa.binary()), pa.array(at, pa.int32()), pa.array(cut, pa.binary())], names=["kh", "key", "s", "cut"])

    return texts.select("data", "key", "runs").mapInArrow(run, "kh long, key binary, s int, cut binary")


def equal_suffixes(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Those of the places whose next size bytes also begin at another of the places."""
    width = min(8, size)
    padded = np.concatenate([x, np.zeros(8, np.uint8)])
    words = np.zeros(len(x), dtype=np.uint64)
    for k in range(width):
        words = words << np.uint64(8) | padded[k : k + len(x)]
    depths = sorted({*range(0, size - width + 1, width), size - width})
    digit = words[at]
    order = np.argsort(digit, kind="stable")
    at, digit = at[order], digit[order]
    new = np.concatenate([[True], digit[1:] != digit[:-1]])[: len(at)]  # where a group begins
    for depth in [*depths[1:], None]:
        counts = np.diff(np.append(np.flatnonzero(new), len(at)))
        held = np.repeat(counts > 1, counts)
        at, new = at[held], new[held]
        if depth is None or not len(at):
            break
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(at)))
        digit = words[at + depth]
        parted = np.logical_or.reduceat(digit != np.repeat(digit[starts], counts), starts)
        if parted.any():  # only groups whose digits differ are sorted
            rows = np.flatnonzero(np.repeat(parted, counts))
            order = np.lexsort((digit[rows], np.cumsum(new)[rows]))
            at[rows], digit[rows] = at[rows][order], digit[rows][order]
            new[1:] |= digit[1:] != digit[:-1]
    return at


def equal_in_groups(cuts: DataFrame, size: int) -> DataFrame:
    """key, s, e of the bytes that equal suffixes cover, for groups that one task holds; cuts are sorted by kh in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(group: list) -> list:
            if len(group) < 2:
                return []
            x = np.frombuffer(b"".join(cut for _, _, cut in group), dtype=np.uint8)
            ends = np.cumsum([len(cut) for _, _, cut in group])
            begins = np.concatenate([[0], ends[:-1]])
            inside = np.zeros(len(x) + 1, dtype=np.int8)  # a string that crosses from one cut to the next is none
            np.add.at(inside, begins, 1)
            np.add.at(inside, ends - size + 1, -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]))
            flags = np.zeros(len(x) + 1, dtype=np.int8)
            flags[equal_suffixes(x, at, size)] = 1
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags])))
            edges = edges.reshape(-1, 2)
            return [(group[g][0], group[g][1] + i - int(begins[g]), group[g][1] + j - 1 - int(begins[g]) + size) for i, j, g in zip(edges[:, 0].tolist(), edges[:, 1].tolist(), (np.searchsorted(begins, edges[:, 0], "right") - 1).tolist(), strict=True)]

        group: list = []
        last, out = None, []
        for b in batches:
            for kh, key, s, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kh != last:
                    out += solve(group)
                    last, group = kh, []
                group.append((key, s, cut))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["key", "s", "e"])
                out = []
        out = solve(group)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.int32()))], names=["key", "s", "e"])

    return cuts.select("kh", "key", "s", "cut").mapInArrow(run, "key binary, s int, e int")


def equal_by_shuffle(cuts: DataFrame, size: int) -> DataFrame:
    """The same for groups of any size: a row for each suffix, told apart by pre-aggregated hashes of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def batch(h: list, of: list, at: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(of, pa.binary()), pa.array(at, pa.int32())], names=["h", "key", "s"])

        for b in batches:
            h, of, at = [], [], []
            for key, s, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(cut) - size + 1
                h += [xxhash.xxh3_128_digest(cut[i : i + size]) for i in range(n)]
                of += [key] * n
                at += range(s, s + n)
                if len(h) > 100_000:
                    yield batch(h, of, at)
                    h, of, at = [], [], []
            yield batch(h, of, at)

    rows = stored(cuts.select("key", "s", "cut").mapInArrow(run, "h binary, key binary, s int"))
    tag = F.xxhash64("key", "s")
    twice = rows.groupBy("h").agg(F.min(tag).alias("t0"), F.max(tag).alias("t1")).where("t0 <> t1").select("h")
    return rows.join(twice, "h", "left_semi").select("key", "s", (F.col("s") + size).alias("e"))


def repeated_spans(texts: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """key, s, e: byte ranges covered by a size-byte string that also starts elsewhere; ranges may overlap.

    texts: id, key, data. Texts alike count as one here, so their copies are for the caller to see.
    """
    runs = stored(runs_of(texts, size, gram))
    tag = F.xxhash64("key", "a").alias("tag")
    alive = stored(runs.select("kh", tag).groupBy("kh").agg(F.min("tag").alias("t0"), F.max("tag").alias("t1")).where("t0 <> t1").select("kh"))
    freed(alive)
    shared = stored(runs.join(alive, "kh", "left_semi").select("*", tag))
    dropped(runs)
    wide = stored(shared.groupBy("kh", "uh").agg(F.min("tag").alias("t0"), F.max("tag").alias("t1")))
    twin = F.col("uh").isNotNull() & (F.col("t0") != F.col("t1"))
    left = size - gram
    whole = stored(shared.join(wide.where(twin).select("kh", "uh"), ["kh", "uh"], "left_semi").select("key", (F.col("a") - left).alias("s"), (F.col("a") + size).alias("e")))
    undecided = wide.groupBy("kh").agg(F.max(F.when(twin, 0).otherwise(1)).alias("open")).where("open = 1").select("kh")
    one = wide.where("uh IS NOT NULL").join(undecided, "kh", "left_semi").select("kh", "uh", F.col("t0").alias("tag"))
    need = shared.where("uh IS NULL").select("kh", "key", "s", "e").unionByName(shared.join(one, ["kh", "uh", "tag"], "left_semi").select("kh", "key", "s", "e"))
    lists = need.distinct().groupBy("key").agg(F.collect_list(F.struct("kh", "s", "e")).alias("runs"))
    first = texts.groupBy("key").agg(F.min("id").alias("first"))
    of = texts.join(lists.join(first, "key"), "key").where(F.col("id").eqNullSafe(F.col("first")))
    cuts = stored(cut_out(of, size))
    dropped(shared)
    dropped(wide)
    many = stored(cuts.groupBy("kh").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_LIMIT).select("kh"))
    small = stored(equal_in_groups(cuts.join(many, "kh", "left_anti").repartition("kh").sortWithinPartitions("kh"), size))
    spans = whole.unionByName(small)
    if many.head(1):
        spans = spans.unionByName(stored(equal_by_shuffle(cuts.join(many, "kh", "left_semi"), size)))
    dropped(cuts)
    return spans


def kept_parts(data: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed runs and what is left of data."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    ends = [0, *(x for r in runs for x in r), len(data)]
    return [(s, e) for s, e in runs], b"".join(data[s:e] for s, e in zip(ends[::2], ends[1::2], strict=True))


def suffix_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, text_kept (bytes), n_bytes, removed (array of start and end), kept_sha256 of each document.

    A byte goes if a size-byte string that covers it starts anywhere else too, in the same text or another. Input:
    doc_id, text; other columns are not read. A null text counts as an empty one; texts under size bytes are kept.
    Repeated rows are documents of their own, so both of a pair of equal rows lose what they share. Texts alike
    pass the sort as one text; texts of any length are read whole, in chunks. Empty tables give no rows.
    text_kept is null where nothing was removed: the text stands as it was.
    """
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    sha = F.sha2("data", 256)
    own = own.select("id", "data", sha.alias("sha")).withColumn("key", F.substring(F.unhex("sha"), 1, 16))
    copied = stored(own.where(F.octet_length("data") >= size).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("copied")))
    spans = repeated_spans(own, size, gram).join(copied, "key", "left_anti")
    marks = spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = own.join(marks.withColumn("copied", F.lit(False)).unionByName(copied.withColumn("spans", F.array().cast("array<struct<s:int,e:int>>"))), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out: list = []
            for data, sha, copied, spans in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if copied is None:
                    out.append((None, len(data), [], sha))
                else:
                    removed, kept = kept_parts(data, [(0, len(data))] if copied else [(x["s"], x["e"]) for x in spans])
                    out.append((kept, len(data), [{"start": s, "end": e} for s, e in removed], hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), kind, pa.string())))], names=["doc_id", "text_kept", "n_bytes", "removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("id", "data", "sha", "copied", "spans").mapInArrow(run, f"doc_id {kind}, text_kept binary, n_bytes long, removed array<struct<start:int,end:int>>, kept_sha256 string")
