"""Operator 2: toxicity from a learnt lexicon, with misspellings and the context of each hit."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_train, stored

#: At most this many labelled rows of each class are learnt from: those with the least hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 8_000, 16_000
#: At most this many terms and stems are kept, by their log-likelihood ratio; learnt words have SHORTEST to LONGEST letters.
MOST_TERMS, SHORTEST, LONGEST = 4_000, 3, 40
#: A term needs this many toxic documents, and this many times the clean documents' share.
LEAST_SUPPORT, LEAST_RATIO = 6, 12.0
#: A stem also needs this many different words below it.
STEM_LENGTHS, LEAST_FAMILY = (4, 5, 6), 4
#: Terms and words shorter than this match without edits; longer ones with one edit or swap, and from LONG_LENGTH on with two edits.
FUZZY_LENGTH, LONG_LENGTH = 5, 10
WINDOW = 6
#: The words of so many texts are looked up together.
TOGETHER = 256
TOKEN = re.compile(r"[^\W_]+")
LEET = str.maketrans("0134578@$", "oieastbas")
RUNS = re.compile(r"(.)\1{2,}")
#: Words of report or denial near a hit, and words of address, in four languages.
REPORT = frozenset("said says quote quoted quotes wrote called word term phrase insult reported claimed alleged sagte sagt zitat wort schrieb nannte begriff behauptete dit disait citation mot terme écrit insulte dijo dice cita palabra término escribió llamó insulto".split())
ADDRESS = frozenset("you your yours youre du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
QUOTED, REPORTED, ADDRESSED = 0.25, 0.5, 1.25


class Lexicon:
    """A trie of terms and stems; find() intersects it with the Levenshtein automaton of a word.

    The automaton walks only the part of the trie that holds terms as near as asked by near_pairs(), for many words at once.
    """

    NONE = (0, 0.0)

    def __init__(self, terms: dict[str, float], stems: dict[str, float]) -> None:
        self.terms, self.memo = terms, {}
        self.root = trie({"$end": terms, "$stem": stems})
        self.by_edits = {1: Spelled([t for t in terms if len(t) >= FUZZY_LENGTH]), 2: Spelled([t for t in terms if len(t) >= LONG_LENGTH])}

    def find(self, word: str) -> tuple[int, float]:
        """Kind and gain: 3 for a term, 2 for a word that starts with a stem, 1 for one edit from a term, else 0."""
        if word not in self.memo:
            self.look_up([word])
        return self.memo[word]

    def look_up(self, words: Iterable[str]) -> None:
        """Find words, so that find() remembers them."""
        if len(self.memo) > 500_000:
            self.memo.clear()
        unknown: dict[str, list[str]] = {}
        for word in words:
            if word in self.memo:
                continue
            found = self._exact(word)
            if not found[0]:
                plain = RUNS.sub(r"\1", word.translate(LEET)) if not word.isalpha() or RUNS.search(word) else word
                if plain != word and (found := self._exact(plain))[0]:
                    found = 1, found[1]
                elif len(plain) >= FUZZY_LENGTH:
                    unknown.setdefault(plain, []).append(word)
            self.memo[word] = found if found[0] else self.NONE
        for most, shortest in ((1, FUZZY_LENGTH), (2, LONG_LENGTH - 2)):
            for plain, near in near_pairs([w for w in unknown if len(w) >= shortest], self.by_edits[most], most).items():
                gain = self._fuzzy(trie({"$end": {t: self.terms[t] for t in near}}), plain, 0, 0, 0, most)
                if gain:
                    self.memo.update((word, (1, gain)) for word in unknown.pop(plain))

    def _exact(self, word: str) -> tuple[int, float]:
        node, stem = self.root, self.NONE
        for c in word:
            node = node.get(c)
            if node is None:
                return stem
            if "$stem" in node:
                stem = (2, node["$stem"])
        return (3, node["$end"]) if "$end" in node else stem

    def _fuzzy(self, node: dict, word: str, at: int, edits: int, depth: int, most: int) -> float:
        """The best gain within so many edits (a swap is one, where only one is allowed). The automaton's state is (at, edits); it walks the trie from node."""
        n = len(word)
        long_enough = depth >= (FUZZY_LENGTH if most == 1 else LONG_LENGTH)
        best = node["$end"] if "$end" in node and long_enough and n - at + edits <= most else 0.0
        if at < n and (child := node.get(word[at])) is not None:
            best = max(best, self._fuzzy(child, word, at + 1, edits, depth + 1, most))
        if edits == most:
            return best
        if at < n:
            best = max(best, self._fuzzy(node, word, at + 1, edits + 1, depth, most))
        for c, child in node.items():
            if len(c) == 1:
                if at < n and c != word[at]:
                    best = max(best, self._fuzzy(child, word, at + 1, edits + 1, depth + 1, most))
                best = max(best, self._fuzzy(child, word, at, edits + 1, depth + 1, most))
        if most == 1 and at + 1 < n and (child := node.get(word[at + 1], {}).get(word[at])) is not None:
            best = max(best, self._fuzzy(child, word, at + 2, edits + 1, depth + 2, most))
        return best


def trie(kinds: dict[str, dict[str, float]]) -> dict:
    """A trie of entries, whose gains stand at their ends under the name of their kind."""
    root: dict = {}
    for end, entries in kinds.items():
        for entry, gain in entries.items():
            node = root
            for c in entry:
                node = node.setdefault(c, {})
            node[end] = gain
    return root


class Spelled:
    """Words ordered by length: their lengths, letters (a row each, filled up with zeros) and 64-bit signatures.

    A signature has a bit for each first, second ... occurrence of a letter, so one edit changes two bits at most.
    """

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(words, key=len)
        self.length = np.fromiter(map(len, self.words), dtype=np.int64, count=len(words))
        letters = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        own = np.repeat(np.arange(len(words)), self.length)
        self.letters = np.zeros((len(words), int(self.length.max(initial=0))), dtype=np.uint32)
        self.letters[own, np.arange(len(own)) - np.repeat(np.cumsum(self.length) - self.length, self.length)] = letters
        key = np.sort(own << 21 | letters)
        at = np.arange(len(key))
        nth = at - np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, at, 0))
        bit = ((key & 0x1FFFFF) * 64 + np.minimum(nth, 63)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)
        self.signature = np.zeros(len(words), dtype=np.uint64)
        np.bitwise_or.at(self.signature, key >> 21, np.uint64(1) << bit)


def near_pairs(words: list[str], terms: Spelled, most: int, block: int = 1 << 22) -> dict[str, list[str]]:
    """For each word the terms within so many edits (a swap is one, where only one is allowed); words without any are left out.

    Words meet terms by length and signature; what meets is settled by the edit distance in a band around the diagonal.
    """
    out: dict[str, list[str]] = {}
    spelled = Spelled(words)
    for n in np.unique(spelled.length):
        lo, hi = np.searchsorted(terms.length, [n - most, n + most + 1])
        start, end = np.searchsorted(spelled.length, [n, n + 1])
        step = max(1, block // max(1, hi - lo))
        for at in range(start, end if lo < hi else start, step):
            differ = np.bitwise_count(spelled.signature[at : min(end, at + step), None] ^ terms.signature[None, lo:hi])
            w, t = np.nonzero(differ <= 2 * most)
            same_letters = differ[w, t] == 0
            w, t = w + at, t + lo
            edits = banded(spelled.letters[w, :n], terms.letters[t], terms.length[t])
            keep = edits <= most
            if most == 1:
                keep |= (edits == 2) & same_letters & (terms.length[t] == n)
            for i, k in zip(w[keep].tolist(), t[keep].tolist(), strict=True):
                out.setdefault(spelled.words[i], []).append(terms.words[k])
    return out


def banded(a: np.ndarray, b: np.ndarray, length: np.ndarray, band: int = 2) -> np.ndarray:
    """The edit distances of rows of a and rows of b, which have the given lengths, where they are at most band; else more."""
    n, far = a.shape[1], np.uint8(100)
    wide = np.zeros((len(b), max(n, b.shape[1]) + 2 * band + 1), dtype=np.uint32)
    wide[:, band : band + b.shape[1]] = b  # column j + band has letter j of b, from 0
    last = [np.full(len(a), d if d >= 0 else far, dtype=np.uint8) for d in range(-band, band + 1)]
    for i in range(1, n + 1):
        row: list[np.ndarray] = []
        for k in range(2 * band + 1):
            j = i + k - band
            if j < 0:
                row.append(np.full(len(a), far, dtype=np.uint8))
                continue
            cell = last[k] + (a[:, i - 1] != wide[:, j - 1 + band]) if j else np.full(len(a), min(i, far), dtype=np.uint8)
            if j and k < 2 * band:
                cell = np.minimum(cell, last[k + 1] + np.uint8(1))
            if j and k:
                cell = np.minimum(cell, row[-1] + np.uint8(1))
            row.append(np.minimum(cell, far))
        last = row
    return np.stack(last)[np.clip(length - n + band, 0, 2 * band), np.arange(len(a))]


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Places between quotation marks on one line."""
    spans, start, closer = [], -1, ""
    for m in re.finditer("[\n\"“”„«»‹›‘’]", text):
        c = m.group()
        if start >= 0 and c == closer:
            spans.append((start, m.start()))
            start = -1
        elif c == "\n":
            start = -1
        elif start < 0 and c in QUOTES:
            start, closer = m.end(), QUOTES[c]
    return spans


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Sums over the hits of a text of gain times context weight, for terms, stems and misspellings; then the number of hits."""
    return features_of([text], lexicon)[0]


def features_of(texts: list[str | None], lexicon: Lexicon) -> list[list[float]]:
    """features() of each text; their words are looked up together."""
    lows = [(t or "").lower() for t in texts]
    founds = [TOKEN.findall(low) for low in lows]
    lexicon.look_up(set().union(*founds))
    return [hits(low, found, lexicon) for low, found in zip(lows, founds, strict=True)]


def hits(low: str, found: list[str], lexicon: Lexicon) -> list[float]:
    """features() of a text in small letters, whose words are found."""
    kinds = {w: k for w in set(found) if (k := lexicon.find(w))[0]}
    out = [0.0, 0.0, 0.0, 0.0]
    if not kinds:
        return out
    spans = quoted_spans(low)
    starts = [m.start() for m in TOKEN.finditer(low)] if spans else []
    s = 0
    for i, word in enumerate(found):
        if word not in kinds:
            continue
        kind, gain = kinds[word]
        while s < len(spans) and spans[s][1] <= starts[i]:
            s += 1
        window = found[max(0, i - WINDOW) : i] + found[i + 1 : i + 1 + WINDOW]
        weight = QUOTED if s < len(spans) and spans[s][0] <= starts[i] else 1.0
        weight *= REPORTED if any(w in REPORT for w in window) else ADDRESSED if any(w in ADDRESS for w in window) else 1.0
        out[3 - kind] += gain * weight
        out[3] += 1
    return out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the rows learnt from, one for each id; the ids sent to all executors are at most MOST_TOXIC + MOST_CLEAN."""
    known = labels.where(in_train(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda x, n: known.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, MOST_TOXIC).unionByName(pick(0, MOST_CLEAN))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic")


def learn_terms(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems that toxic documents hold far more often than clean ones, each with its log ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {w for w in TOKEN.findall((text or "").lower()) if len(w) <= LONGEST}
                counts.update((w, toxic) for w in found if len(w) >= SHORTEST)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([counts[k] if k[1] else 0 for k in keys], pa.int64()), pa.array([0 if k[1] else counts[k] for k in keys], pa.int64())], names=["w", "t", "c"])

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, nc = n.get(1, 0), n.get(0, 0)
    if not nt or not nc:
        return {}, {}
    words = rows.mapInArrow(run, "w string, t long, c long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    ratio = ((F.col("t") + 0.5) / (nt + 1)) / ((F.col("c") + 0.5) / (nc + 1))
    enough = (F.col("t") >= LEAST_SUPPORT) & (ratio >= LEAST_RATIO)
    top = lambda d: {r.w: r.g for r in d.where(enough).select("w", F.log(ratio).alias("g"), (F.col("t") * F.log(ratio)).alias("o")).orderBy(F.desc("o"), "w").limit(MOST_TERMS).collect()}
    below = words.select("w", "t", "c", F.explode(F.filter(F.array(*[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in STEM_LENGTHS]), lambda s: s.isNotNull())).alias("s"))
    stems = below.groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.when(F.col("t") > 1, 1)).alias("family")).where(F.col("family") >= LEAST_FAMILY).withColumnRenamed("s", "w")
    return top(words), top(stems)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Logistic regression on log(1 + feature), classes weighted alike, by Newton steps."""
    x = np.column_stack([np.log1p(x), np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * min(len(y), 2000)
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def apply_features(df: DataFrame, terms: dict[str, float], stems: dict[str, float], weights: list[float] | None) -> DataFrame:
    """The first column of df with the features of its second, text, or with their score if weights are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, stems)
        for b in batches:
            f = [x for at in range(0, b.num_rows, TOGETHER) for x in features_of(b.column(1).slice(at, TOGETHER).to_pylist(), lexicon)]
            if weights is None:
                cols = [pa.array(f, pa.list_(pa.float64()))]
            else:
                cols = [pa.array([score(x, weights) for x in f], pa.float64()), pa.array([int(x[3]) for x in f], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["key", "features"] if weights is None else ["key", "score", "hits"])

    kind = df.schema[0].dataType.simpleString()
    return df.mapInArrow(run, f"key {kind}, " + ("features array<double>" if weights is None else "score double, hits long"))


def score(x: list[float], weights: list[float]) -> float:
    z = weights[-1] + sum(w * math.log1p(v) for w, v in zip(weights, x, strict=False))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and hits (how many lexicon hits) of each document.

    docs: doc_id, text; labels: doc_id, toxic, learnt from only where held_out is false, on at most MOST_TOXIC and
    MOST_CLEAN rows, one for each doc_id; other columns are not read. The lexicon holds at most MOST_TERMS terms and as
    many stems, of words of SHORTEST to LONGEST letters. Null and empty texts score as texts without hits. A doc_id
    labelled twice counts as toxic if either label is 1; null labels are not learnt from. Without labels of both
    classes every score is the share of toxic labels (0 without any). Repeated rows each give a row.
    """
    rows = stored(labelled(docs, labels))
    terms, stems = learn_terms(rows)
    got = [(r.key, r.features) for r in apply_features(rows.select("toxic", "text"), terms, stems, None).collect()] if terms or stems else []
    if got:
        weights = fit(np.array([f for _, f in got], dtype=float), np.array([k for k, _ in got], dtype=float))
    else:
        n, t = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        share = t / n if n else 0.0
        weights = [0.0, 0.0, 0.0, 0.0, math.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0]
    out = apply_features(docs.select("doc_id", F.col("text").cast("string")), terms, stems, weights)
    return out.select(F.col("key").alias("doc_id"), F.coalesce(~in_train(F.col("key")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
