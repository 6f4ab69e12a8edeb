"""Operator 4: benchmark passages in documents, found by CGK embedding and bit sampling, proved by edit distance."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+")
#: A passage counts within this share of edits (words put in, left out or changed) of the item's words.
MOST_EDITS = 0.2
#: Items of fewer words must be met exactly.
FEWEST_WORDS = 8
#: Windows are as long as the item, this long at most; longer items are looked for by each stretch of that length.
WIDEST = 64
#: Symbols sampled for a signature, and the recall aimed at for passages at MOST_EDITS, where about AGREE of symbols agree.
SAMPLED, RECALL, AGREE = 3, 0.95, 0.5
#: A window is walked only if it holds as many of the item's runs of so many words as any match must.
RUN = 3
#: One scan takes at most this many items and characters, some 500 MB once indexed; a larger benchmark takes more scans.
BLOCK_ITEMS, BLOCK_CHARS = 100_000, 24_000_000
SEED = 11
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def tables_for(recall: float, sampled: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREE**sampled))


def edits_allowed(n: int, most: float) -> int:
    return int(most * n) if n >= FEWEST_WORDS else 0


def best_match(item: list[int], region: list[int]) -> tuple[int, int, int]:
    """Least edit distance of item to any stretch of region, and that stretch; bit-parallel over the item's words."""

    def ends(a: list[int], b: list[int], fixed: bool) -> list[int]:
        at: dict[int, int] = {}
        for i, x in enumerate(a):
            at[x] = at.get(x, 0) | 1 << i
        full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
        up, down, score, out = full, 0, len(a), [len(a)]
        for x in b:
            eq = at.get(x, 0)
            across = (((eq & up) + up) ^ up) | eq | down
            right, left = down | (full & ~(across | up)), up & across
            score += bool(right & top) - bool(left & top)
            right, left = right << 1 | fixed, left << 1
            up, down = (left | ~((eq | down) | right)) & full, right & (eq | down) & full
            out.append(score)
        return out

    scores = ends(item, region, False)
    least = min(scores)
    end = scores.index(least)
    back = ends(item[::-1], region[:end][::-1], True)
    return least, end - back.index(min(back)), end


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def runs(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the words at each place and the size - 1 next ones."""
    h = codes[: max(len(codes) - size + 1, 0)].astype(np.uint64)
    for k in range(1, size):
        h = mixed(h * MIX[0] + codes[k : k + len(h)].astype(np.uint64))
    return h


def runs_needed(size: int, most: float) -> int:
    """How many runs of an item of that size a window at a match holds at least: an edit spoils RUN of them, or moves one out."""
    q = min(RUN, size)
    return max(1, size - q + 1 - (q + 1) * edits_allowed(size, most)) if size < WIDEST else 1


class Matcher:
    """Signatures of a block of items, ready to look for their passages in word codes."""

    def __init__(self, items: list[tuple[object, list[str]]], most: float, recall: float) -> None:
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        self.vocabulary, self.ids, self.most = vocabulary, [i for i, _ in items], most
        self.items = [np.array([vocabulary[w] for w in ws], dtype=np.int32) for _, ws in items]
        self.allowed = np.array([edits_allowed(len(ws), most) for ws in self.items])
        self.tables = tables_for(recall, SAMPLED)
        stretches: dict[int, list[tuple[int, int]]] = {}
        for k, ws in enumerate(self.items):
            size = min(len(ws), WIDEST)
            if size:
                places = range(0, len(ws) - size + 1, size)
                stretches.setdefault(size, []).extend((k, at) for at in sorted({*places, len(ws) - size}))
        self.classes, grams = {}, {}
        for size, rows in sorted(stretches.items()):
            codes = np.stack([self.items[k][at : at + size] for k, at in rows])
            known = []
            for sign in self.signatures(codes):
                order = np.argsort(sign, kind="stable")
                known.append((sign[order], order))
            self.classes[size] = (np.array(rows), known)
            q = min(RUN, size)
            own = np.unique(np.concatenate([runs(codes.T[k : k + q], q)[0] for k in range(size - q + 1)]))
            grams.setdefault(q, []).append((own, np.full(len(own), 1 << (size - 1), dtype=np.uint64)))
        self.grams = {}
        for q, parts in grams.items():
            h, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, sizes = h[order], sizes[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            seen = np.zeros(1 << 20, dtype=bool)
            seen[h >> np.uint64(44)] = True
            self.grams[q] = (h[first], np.bitwise_or.reduceat(sizes, first), seen)

    def signatures(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """For each table the CGK walk of each window, kept at the sampled times.

        A walk writes the word it stands on, then moves on or stays as a random bit of that word and time tells. Code -1
        stands behind a window, where every walk stays.
        """
        count, width = windows.shape
        rng = np.random.default_rng([SEED, width])
        padded = np.full((count, width + 1), -1, dtype=np.int64)
        padded[:, :width] = windows
        padded = padded.ravel()
        past = padded < 0
        own = mixed(padded.astype(np.uint64) * MIX[0])
        for table in range(self.tables):
            times = np.sort(rng.choice(2 * width, size=min(SAMPLED, 2 * width), replace=False)).tolist()
            at, sign = np.arange(0, len(padded), width + 1), np.zeros(count, dtype=np.uint64)
            for t in range(times[-1] + 1):
                if not t % 64:
                    bits = mixed(own + np.uint64((2 * table + t // 64 + 1) * int(MIX[1]) % (1 << 64)))
                    bits[past] = 0
                if t in times:
                    sign = (sign ^ (padded[at] + 2).astype(np.uint64)) * MIX[0]
                    sign ^= sign >> np.uint64(29)
                at += (bits[at] >> np.uint64(t % 64) & np.uint64(1)).astype(np.int64)
            yield sign

    def search(self, codes: np.ndarray, begins: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document, item) to distance, first and end word. Documents begin at begins; a 0 code ends each.

        What is found in a document depends on its own words alone, not on those beside it.
        """
        seen: set[tuple[int, int, int]] = set()
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        ends = np.append(begins[1:] - 1, len(codes) - 1)
        hits = {}
        for q, (values, sizes, first) in self.grams.items():
            h = runs(codes, q)
            maybe = np.flatnonzero(first[h >> np.uint64(44)])
            place = np.minimum(np.searchsorted(values, h[maybe]), len(values) - 1)
            met = values[place] == h[maybe]
            hits[q] = (maybe[met], sizes[place[met]])
        for size, (rows, tables) in self.classes.items():
            q = min(RUN, size)
            at, sizes = hits[q]
            at = at[sizes >> np.uint64(size - 1) & np.uint64(1) > 0]
            for part in range(0, len(at), 1 << 14):
                starts = np.unique(at[part : part + (1 << 14), None] - np.arange(size - q + 1))
                starts = starts[starts >= 0]
                top = np.minimum(starts + size, ends[np.searchsorted(begins, starts, "right") - 1]) - q
                held = np.searchsorted(at, top, "right") - np.searchsorted(at, starts, "left")
                starts = starts[held >= runs_needed(size, self.most)]
                for k in range(0, len(starts), 1 << 13):
                    self.look(codes, begins, ends, starts[k : k + (1 << 13)], size, rows, tables, seen, best)
        return best

    def look(self, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, size: int, rows: np.ndarray, tables: list, seen: set, best: dict) -> None:
        """Meet the windows at starts with the stretches of that size."""
        docs = np.searchsorted(begins, starts, "right") - 1
        place = starts[:, None] + np.arange(size)
        windows = np.where(place < ends[docs][:, None], codes[np.minimum(place, len(codes) - 1)], -1)
        for sign, (values, order) in zip(self.signatures(windows), tables, strict=True):
            low, high = np.searchsorted(values, sign, "left"), np.searchsorted(values, sign, "right")
            hit = np.flatnonzero(high > low)
            n = high[hit] - low[hit]
            w = np.repeat(hit, n)
            which = rows[order[np.repeat(low[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]]
            for p, d, k in zip((starts[w] - which[:, 1]).tolist(), docs[w].tolist(), which[:, 0].tolist(), strict=True):
                begin = int(begins[d])
                key = (d, k, (p - begin) // (int(self.allowed[k]) + 1))
                if key not in seen:
                    seen.add(key)
                    self.verify(codes, begin, int(ends[d]), d, k, p, best)

    def verify(self, codes: np.ndarray, begin: int, end: int, d: int, k: int, p: int, best: dict) -> None:
        item, most = self.items[k].tolist(), int(self.allowed[k])
        low, high = max(begin, p - 2 * most - 1), min(end, p + len(item) + 2 * most + 1)
        region = codes[low:high].tolist()
        if (Counter(item) & Counter(region)).total() < len(item) - most:
            return
        distance, s, e = best_match(item, region)
        found = (distance, low + s - begin, low + e - begin)
        if distance <= most and found < best.get((d, k), (most + 1,)):
            best[d, k] = found


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """The items in blocks of bounded size."""
    block, chars = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        ws = tokens(r.text)
        if not ws:
            continue
        if block and (len(block) >= BLOCK_ITEMS or chars + len(r.text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r.item_id, ws))
        chars += len(r.text)
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: float = MOST_EDITS, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, distance, similarity, first_word, end_word of each item found in each document.

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. Words are lower-case runs of letters
    and digits. Windows as long as an item (WIDEST words at most) at every place of a whole text are embedded, but for
    those with fewer of the item's runs of words than any match must have. Items are indexed once on the driver and
    sent to the executors in blocks of bounded size, so documents are scanned once, without a shuffle, unless the
    benchmark is over BLOCK_ITEMS items or BLOCK_CHARS characters; then once a block. Passages are reported with the
    exact least distance; those with edits are met with the given recall, exact ones always. What is found does not
    depend on how rows are dealt out. Null and empty texts and items match nothing; repeated rows each give their
    rows; of places with the same distance the first one verified counts. Empty tables give no rows.
    """
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, distance int, similarity double, first_word int, end_word int"
    rows = docs.select("doc_id", F.col("text").cast("string"))
    out = None
    for block in blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Matcher(block, most, recall))
        found = rows.mapInArrow(_search(sent, benchmark), kinds)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], kinds) if out is None else out


def _search(sent: Broadcast, benchmark: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = sent.value
        get = matcher.vocabulary.get

        def flush(ids: list, codes: list, begins: list) -> pa.RecordBatch:
            best = matcher.search(np.concatenate(codes), np.array(begins))
            keys = sorted(best)
            n = [len(matcher.items[k]) for _, k in keys]
            v = [best[x] for x in keys]
            cols = [pa.array([x[j] for x in v], pa.int32()) for j in range(3)]
            ids = pa.array([ids[d] for d, _ in keys], id_kind)
            return pa.RecordBatch.from_arrays([ids, pa.array([matcher.ids[k] for _, k in keys], kind), cols[0], pa.array([1 - x[0] / m for x, m in zip(v, n, strict=True)], pa.float64()), cols[1], cols[2]], names=["doc_id", "item_id", "distance", "similarity", "first_word", "end_word"])

        ids: list = []
        codes: list = []
        begins: list = []
        total = 0
        id_kind = pa.null()
        for b in batches:
            id_kind = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ws = tokens(t.as_py())
                if not ws:
                    continue
                ids.append(i)
                begins.append(total)
                codes.append(np.array([*(get(w, 0) for w in ws), 0], dtype=np.int32))
                total += len(ws) + 1
                if total > 400_000:
                    yield flush(ids, codes, begins)
                    ids, codes, begins, total = [], [], [], 0
        if ids:
            yield flush(ids, codes, begins)

    return run
