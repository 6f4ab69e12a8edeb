"""Operator 12: packing documents into sequences by linear grouping.

Lengths are whole numbers up to the capacity of a sequence, so a table of at most that many counts says all that a
packing needs to know, whatever the number of documents. On it the driver works out the packing as ranges:

- Large lengths, sorted, are dealt into groups of equal cardinality and rounded up to the largest of their group. For
  these few sizes, configurations (how many of which size fill a sequence) and how often to use each are optimised by
  column generation: a linear programme whose new columns come from a knapsack over the capacity.
- Actual documents take the places of their group in order of length. What is left of a sequence then is known, and
  alike over long ranges of sequences.
- The large documents that whole multiples leave over, then the small ones, from the longest down, go by best fit:
  into the sequence with the least room that takes them.

Which lengths are large is a matter of the lengths at hand: few small ones leave little to fill gaps with, many make
configurations needless. So the packing is worked out for each part of the capacity in LARGE_PARTS, and the one with the
fewest sequences is taken.

The documents are numbered within their length by counters of the tasks that tokenize them and by offsets of those
counters; a lookup in the ranges then gives each its sequence and its place, with no shuffle by sequence.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 2048
#: Lengths over the capacity divided by one of these are large; so many sizes they are rounded to.
LARGE_PARTS, GROUPS = (2, 3, 4, 8), 64
#: Column generation ends at the optimum or after so many columns; fewer columns still give a whole packing.
MOST_COLUMNS = 3000
#: Id after each document.
END = 0
#: Words whose ids a worker remembers, texts whose words it holds at once, and characters of a text that it splits at once.
REMEMBERED, TEXTS, STRETCH = 1_000_000, 512, 1 << 20
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: How the byte-level vocabulary parts a text of the Latin characters above, ASCII digits, signs and white space; other
#: texts go to the tokenizer whole.
WORD = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
OTHER = re.compile(rf"[^\x09-\x0d\x20-\x7e{LETTERS}]")
GAP = re.compile(r"(?<=\S) (?=\S)")
_TOKENIZERS: dict = {}


class Ids:
    """Ids of texts as little-endian 32-bit numbers, by a tokenizers file; a worker keeps one, with its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.words: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, texts: list[str]) -> list[bytes]:
        parted = [[] if OTHER.search(t) else self.parts(t) for t in texts]
        new = list(set().union(*parted).difference(self.words))
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = list(set().union(*parted))
        self.words.update(zip(new, self.encoded(new), strict=True))
        whole = iter(self.encoded([t for t, p in zip(texts, parted, strict=True) if t and not p]))
        return [b"".join(map(self.words.__getitem__, p)) if p or not t else next(whole) for t, p in zip(texts, parted, strict=True)]

    @staticmethod
    def parts(text: str) -> list[str]:
        found, at = [], 0
        while at < len(text):
            gap = GAP.search(text, at + STRETCH)
            end = gap.start() if gap else len(text)
            found += WORD.findall(text[at:end])
            at = end
        return found


def ids_of(path: str) -> Ids:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Ids(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, capacity: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task and k: the piece is the k-th of its length in the task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, ids = TaskContext.get().partitionId(), [0] * (capacity + 1), ids_of(path)
        for b in (own.slice(k, TEXTS) for own in batches for k in range(0, own.num_rows, TEXTS)):
            row, piece, start, length, crc, ks, cut = [], [], [], [], [], [], []
            for i, own in enumerate(ids.of([t or "" for t in b.column(1).to_pylist()])):
                own += array.array("I", [END]).tobytes()
                at, n, p = 0, len(own) // 4, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    part = own[4 * at : 4 * (at + size)]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    ks.append(seen[size])
                    cut.append(part)
                    seen[size] += 1
                    at, p = at + size, p + 1
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(row), pa.int32()), pa.array(ks, pa.int64())]
            if with_ids:
                ends = np.cumsum([0, *length]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cut), dtype="<i4"))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "k", *["ids"] * with_ids])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, k long" + ", ids array<int>" * with_ids)


def best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest worth, by dynamic programming over the number of documents in it."""
    at = np.arange(capacity + 1)[:, None] - sizes[None, :]
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        more = np.where(at >= 0, best[at] + worth, -1.0)
        which = more.argmax(axis=1)
        gain = more[np.arange(capacity + 1), which]
        better = gain > best
        chosen.append(np.where(better, which, -1))
        best = np.where(better, gain, best)
    column, left = np.zeros(len(sizes)), capacity
    for which in reversed(chosen):
        if which[left] >= 0:
            column[which[left]] += 1
            left -= sizes[which[left]]
    return float(best[capacity]), column


def configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """How many of each size, and how often; whole multiples of an optimal fractional solution, never more than wanted."""
    if not sizes:
        return []
    s, d = np.array(sizes), np.array(wanted, dtype=float)
    basis = np.diag(capacity // s).astype(float)
    for _ in range(MOST_COLUMNS):
        amounts = np.linalg.solve(basis, d)
        worth = np.linalg.solve(basis.T, np.ones(len(s)))
        value, column = best_column(s, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(amounts, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amounts = np.linalg.solve(basis, d)
    out, left = [], list(wanted)
    for k in np.argsort(-amounts):
        column = basis[:, k].round().astype(int).tolist()
        often = min([int(max(amounts[k], 0) + 1e-6), *(n // m for n, m in zip(left, column, strict=True) if m)])
        if often:
            out.append((column, often))
            left = [n - m * often for n, m in zip(left, column, strict=True)]
    return out


def planned(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, part: int = 8) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    """The number of sequences, and length, first number, end, first sequence, documents a sequence, first place of each range.

    The number r of a length's range goes to sequence (r - first) // documents further on. There are a few ranges for
    each length, however many documents there are.
    """
    large = sorted((n for n in counts if capacity // part < n < capacity), reverse=True)
    ranges: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # what is left of a sequence: first sequence, how many such
    levels: list[int] = []
    sequences = 0

    def opened(first: int, n: int, left: int) -> None:
        if n and left:
            if not room.get(left):
                room[left] = []
                insort(levels, left)
            room[left].append((first, n))

    def filled(length: int, first: int, n: int) -> None:
        nonlocal sequences
        while n:
            k = bisect_left(levels, length)
            if k == len(levels):
                opened(sequences, -(-n // (capacity // length)), capacity)
                sequences += -(-n // (capacity // length))
                k = bisect_left(levels, length)
            left = levels[k]
            begin, alike = room[left].pop()
            if not room[left]:
                levels.pop(k)
            each = min(left // length, n)
            used = min(alike, n // each)
            ranges.append((length, first, first + each * used, begin, each, capacity - left))
            opened(begin + used, alike - used, left)
            opened(begin, used, left - each * length)
            first, n = first + each * used, n - each * used

    if counts.get(capacity):
        filled(capacity, 0, counts[capacity])
    total = sum(counts[n] for n in large)
    starts = np.cumsum([0, *(counts[n] for n in large)])  # large documents in order, longest first
    cuts = sorted({round(total * k / groups) for k in range(groups + 1)}) if len(large) > groups else starts.tolist()  # so few lengths need no rounding
    sizes: list[int] = []
    bounds: list[int] = []
    for at in cuts[:-1]:
        size = large[int(np.searchsorted(starts, at, "right")) - 1]
        if not sizes or size < sizes[-1]:
            sizes.append(size)
            bounds.append(at)
    bounds.append(total)
    cursor = bounds[:-1]
    for column, often in configurations(sizes, [int(b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], capacity):
        places = []
        for k, m in enumerate(column):
            for _ in range(m):
                places.append(int(cursor[k]))
                cursor[k] += often
        edges = sorted({0, often, *(int(e) - p for p in places for e in starts[np.searchsorted(starts, p, "right") : np.searchsorted(starts, p + often, "left")])})
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            used = 0
            for p in places:
                which = int(np.searchsorted(starts, p + i, "right")) - 1
                r = p + i - int(starts[which])
                ranges.append((large[which], r, r + j - i, sequences + i, 1, used))
                used += large[which]
            opened(sequences + i, j - i, capacity - used)
        sequences += often
    for at, end in zip(cursor, bounds[1:], strict=True):
        while at < end:
            which = int(np.searchsorted(starts, at, "right")) - 1
            n = int(min(end, starts[which + 1]) - at)
            filled(large[which], int(at - starts[which]), n)
            at += n
    for length in sorted((n for n in counts if n <= capacity // part), reverse=True):
        filled(length, 0, counts[length])
    return sequences, ranges


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of a document; ids on request.

    path: a file of the tokenizers library. A document is its ids and one END; only what is longer than a sequence is
    cut, and then the first piece is the shorter one. Input: doc_id, text; other columns are not read. A null text
    counts as an empty one, which is a piece of END alone. Repeated rows are documents of their own. Texts of any
    length are read whole, in stretches; an Arrow row holds one. Empty tables give no rows. Pieces of one length are
    interchangeable: which of them goes where depends on how the input is parted, the number of sequences does not.
    """
    rows = stored(pieces(docs, path, capacity, with_ids))
    tasks = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = stored(tasks.select("task", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")))
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    _, ranges = min((planned(counts, capacity, groups, part) for part in LARGE_PARTS), key=lambda p: p[0])
    plan = np.array(sorted(ranges), dtype=np.int64).reshape(-1, 6)
    key = plan[:, 0] << 44 | plan[:, 1]
    kept = [c for c in rows.columns if c not in ("task", "k")]
    placed = rows.join(before.drop("n"), ["task", "length"]).select(*kept, (F.col("k") + F.col("before")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(name).to_numpy(zero_copy_only=False) for name in ("length", "number"))
            at = np.searchsorted(key, length << 44 | number, "right") - 1
            further, which = np.divmod(number - plan[at, 1], plan[at, 4])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(plan[at, 3] + further), pa.array(plan[at, 5] + which * length)], names=[*kept, "sequence_id", "offset"])

    of = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    out = placed.mapInArrow(run, ", ".join(f"{c} {of[c]}" for c in kept) + ", sequence_id long, offset long")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids and the pieces (doc_id, piece, offset, length) of each sequence; placed: packed(with_ids=True)."""
    own = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    parts = placed.groupBy("sequence_id").agg(own.alias("_parts"))
    return parts.select("sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"), F.transform("_parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"))
