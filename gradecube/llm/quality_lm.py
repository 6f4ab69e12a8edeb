"""Operator 6: interpolated modified Kneser-Ney over characters, trained on trusted text.

N-grams are strings of ORDER characters, as they stand in the text, so the tables grow with what the corpus holds.
Counts, continuation counts, context totals and back-off weights are Spark tables sharded by n-gram or context and
joined on those keys. Documents are scored by joins too: of each document the n-grams outside a head of fixed size go,
summed by document and n-gram, to a table of all such n-grams, whose probabilities back off from join to join. The
head, the most frequent n-grams, is sent to the executors, which spares the shuffle of most of the text and changes
no result.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored

ORDER = 5
#: What stands before the start of a text.
START = "\x02"
#: At most so many n-grams are sent to the executors.
HEAD = 1 << 17
#: Documents above this quantile of the held-out trusted documents' perplexity in their language go.
QUANTILE = 0.99
#: The limit is raised by a factor, and a text spared unless it is so many standard errors above it; 1 and 0 give the plain rule.
MARGIN, DEVIATIONS = 1.05, 2.0
#: One in so many trusted texts sets the limits and is not trained on, for a text that was has a lower perplexity.
HELD = 8
#: A language's limit is drawn towards that of all as if by so many more documents with the quantile of all.
POOLED = 20
#: A quantile of few documents is too low, so a limit is raised by so many standard errors of their mean log perplexity.
ERRORS = 2.0
#: Characters worked on at a time, and n-grams that a task counts before it hands them on.
PIECE, COUNTED = 1 << 18, 1 << 18
#: Texts whose n-grams outside the head a task holds at once.
TEXTS = 2000
BASE = np.uint64(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer((START * (ORDER - 1) + text).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of each ORDER consecutive code points."""
    n = len(x) - ORDER + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(ORDER):
        h = (h + x[k : k + n] + np.uint64(1)) * BASE
        h ^= h >> np.uint64(31)
    return h


def gram_strings(x: np.ndarray, at: np.ndarray) -> list[str]:
    """The n-grams that begin at those places."""
    rows = np.ascontiguousarray(x[at[:, None] + np.arange(ORDER)]).astype("<u4")
    text = rows.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[k : k + ORDER].encode("utf-8", "replace").decode("utf-8") for k in range(0, len(text), ORDER)]


def gathered(texts: Iterator[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of about PIECE characters of several texts, where their n-grams begin, and whose text each is of."""
    parts, begins, owners, size = [], [], [], 0
    for i, text in texts:
        x = points(text)
        for at in range(0, len(x) - ORDER + 1, PIECE):
            piece = x[at : at + PIECE + ORDER - 1]
            begins.append(np.arange(size, size + len(piece) - ORDER + 1))
            owners.append(np.full(len(begins[-1]), i))
            parts.append(piece)
            size += len(piece)
            if size > PIECE:
                yield np.concatenate(parts), np.concatenate(begins), np.concatenate(owners)
                parts, begins, owners, size = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(begins), np.concatenate(owners)


def gram_counts(texts: DataFrame) -> DataFrame:
    """g, n: how often each n-gram occurs, summed in pieces and then by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.string()), pa.array(known.values(), pa.int64())], names=["g", "n"])

        every = ((0, t.as_py() or "") for b in batches for t in b.column(0))
        for x, at, _ in gathered(every):
            _, first, n = np.unique(gram_hashes(x)[at], return_index=True, return_counts=True)
            for g, c in zip(gram_strings(x, at[first]), n.tolist(), strict=True):
                known[g] = known.get(g, 0) + c
            if len(known) > COUNTED:
                yield out()
                known = {}
        yield out()

    return texts.select("text").mapInArrow(run, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(grams: DataFrame) -> list[float]:
    """D1, D2, D3+ of Chen and Goodman from the counts of counts."""
    row = grams.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n = [float(x) for x in row]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(k - 0.05, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else k / 2 for k in (1, 2, 3)]


def discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def last(gram: Column, k: int) -> Column:
    """The last k characters of an n-gram of at least k."""
    return F.substring(gram, -k, k) if k else F.lit("")


class Model:
    """Sharded tables by order: grams (g, p) and contexts (c, b); the probability of a character never seen."""

    def __init__(self, grams: dict[int, DataFrame], contexts: dict[int, DataFrame], unseen: float, head: Broadcast) -> None:
        self.grams, self.contexts, self.unseen, self.head = grams, contexts, unseen, head


def kneser_ney(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame], float]:
    """The tables of each order, from the counts of the highest."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: the characters that precede
        levels[k] = stored(levels[k + 1].groupBy(last(F.col("g"), k).alias("g")).agg(F.count("*").alias("n")))
    symbols = levels[1].count() + 1
    grams, contexts, unseen = {}, {}, 1.0 / symbols
    for k in range(1, ORDER + 1):
        d = discounts(levels[k])
        t = levels[k].select("g", F.col("n").cast("double").alias("n"), F.substring("g", 1, k - 1).alias("c"), last(F.col("g"), k - 1).alias("low"))
        own = F.greatest(F.lit(0.0), F.col("n") - discount(F.col("n"), d)) / F.col("total")
        sums = [F.sum("n").alias("total"), F.sum(F.least("n", discount(F.col("n"), d))).alias("mass")]
        if k == 1:  # one context
            total, mass = t.agg(*sums).first()
            b = mass / total if total else 1.0
            t = t.withColumn("total", F.lit(total).cast("double")).withColumn("b", F.lit(b)).withColumn("q", F.lit(1.0 / symbols))
            unseen *= b
        else:
            contexts[k] = stored(t.groupBy("c").agg(*sums).select("c", "total", (F.col("mass") / F.col("total")).alias("b")))
            t = t.join(contexts[k], "c").join(grams[k - 1].select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
        grams[k] = stored(t.select("g", "n", (own + F.col("b") * F.col("q")).alias("p")))
        if k < ORDER:
            dropped(levels[k])
    return grams, contexts, unseen


def head_of(grams: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and losses of the most frequent n-grams: as many steps of frequency as stay within the limit."""
    step = F.floor(F.log2("n") * 8).cast("int")
    held, low = 0, None
    for r in sorted(grams.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True):  # some 8 steps for each doubling
        if held + r.n > most:
            break
        held, low = held + r.n, r.s
    if low is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    rows = grams.where(step >= low).select("g", "p").toArrow()  # at most `most`
    x = np.frombuffer("".join(rows["g"].to_pylist()).encode("utf-32-le"), dtype="<u4")
    h = gram_hashes(x)[::ORDER]
    order = np.argsort(h)
    return h[order], -np.log(rows["p"].to_numpy())[order]


def summed(texts: DataFrame, head: Broadcast) -> DataFrame:
    """The columns of texts but for text, with size, loss and square (sums over the n-grams of the head) and rest: the others and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, losses = head.value
        for b in (own.slice(k, TEXTS) for own in batches for k in range(0, own.num_rows, TEXTS)):
            n = b.num_rows
            size, loss, square = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            owners, names, counts = [np.zeros(0, np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)]
            for x, at, owner in gathered((i, t.as_py() or "") for i, t in enumerate(b.column(b.num_columns - 1))):
                values, first, of = np.unique(gram_hashes(x)[at], return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
                met = known[place] == values if len(known) else np.zeros(len(values), bool)
                own = np.where(met, losses[place], 0.0) if len(known) else np.zeros(len(values))
                size += np.bincount(owner, minlength=n)
                loss += np.bincount(owner, own[of], n)
                square += np.bincount(owner, own[of] ** 2, n)
                new = np.flatnonzero(~met)
                if len(new):
                    number = np.zeros(len(values), np.int64)
                    number[new] = np.arange(len(new))
                    out = ~met[of]
                    pairs, count = np.unique(owner[out] * len(new) + number[of[out]], return_counts=True)
                    owners.append(pairs // len(new))
                    names.append(pa.array(gram_strings(x, at[first[new]]), pa.string()).take(pa.array(pairs % len(new))))
                    counts.append(count)
            owner = np.concatenate(owners)
            order = pa.array(np.argsort(owner, kind="stable"))
            rows = pa.StructArray.from_arrays([pa.concat_arrays(names).take(order), pa.array(np.concatenate(counts)).take(order)], names=["g", "n"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(ends), rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size), pa.array(loss), pa.array(square), rest], names=[*b.schema.names[:-1], "size", "loss", "square", "rest"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text"]
    return texts.select(*[c for c in texts.columns if c != "text"], "text").mapInArrow(run, ", ".join([*kept, "size long", "loss double", "square double", "rest array<struct<g:string,n:long>>"]))


def backed_off(grams: DataFrame, model: Model) -> DataFrame:
    """g, p of each n-gram: its own probability where it was seen, else the context's weight times that of a shorter one."""
    t = grams.select("g", F.lit(1.0).alias("w"), F.lit(None).cast("double").alias("p"))
    for k in range(ORDER, 0, -1):
        found = model.grams[k].select(F.col("g").alias("_g"), F.col("p").alias("_p"))
        t = t.join(found, last(F.col("g"), k) == F.col("_g"), "left").select("g", "w", F.coalesce("p", F.col("w") * F.col("_p")).alias("p"))
        if k > 1:
            context = F.substring(last(F.col("g"), k), 1, k - 1)
            weights = model.contexts[k].select(F.col("c").alias("_c"), F.col("b").alias("_b"))
            t = t.join(weights, context == F.col("_c"), "left").select("g", (F.col("w") * F.coalesce("_b", F.lit(1.0))).alias("w"), "p")
    return t.select("g", F.coalesce("p", F.col("w") * F.lit(model.unseen)).alias("p"))


def perplexities(docs: DataFrame, model: Model, deviations: float) -> DataFrame:
    """The columns of docs but for text, with perplexity and low: what it is so many standard errors lower; null without text."""
    keep = [c for c in docs.columns if c != "text"]
    own = stored(summed(docs.select(*keep, F.monotonically_increasing_id().alias("_row"), "text"), model.head), "zstd")
    rest = own.select("_row", F.inline("rest"))
    new = stored(rest.select("g").distinct())
    loss = stored(backed_off(new, model).select("g", (-F.log("p")).alias("x")))
    dropped(new)
    others = rest.join(loss, "g").groupBy("_row").agg(F.sum(F.col("n") * F.col("x")).alias("_l"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("_s"))
    n = F.nullif(F.col("size"), F.lit(0))
    mean = (F.col("loss") + F.coalesce("_l", F.lit(0.0))) / n
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("square") + F.coalesce("_s", F.lit(0.0))) / n - mean * mean) / n)
    return own.drop("rest").join(others, "_row", "left").select(*keep, F.exp(mean).alias("perplexity"), F.exp(mean - deviations * spread).alias("low"))


@contextlib.contextmanager
def prefiltered(spark: SparkSession) -> Iterator[None]:
    """Let Spark drop rows by a Bloom filter of fixed size before they are shuffled, whatever the size of the scan."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the documents labelled with quality 1 but for those held out, and the latter, stored: lang, text.

    Copies of a text are held out together. Where one of both parts would be empty, all are in both.
    """
    good = labels.where("quality = 1").select("doc_id")
    texts = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    with prefiltered(docs.sparkSession):
        trusted = stored(texts.join(good.hint("merge"), "doc_id", "left_semi").select("lang", "text", held_out(F.col("text")).alias("held")))  # labels grow with the input, so they are never broadcast
    filled = trusted.where("text <> ''").agg(F.count_if("held"), F.count_if(~F.col("held"))).first()
    trained, held = (trusted.where("NOT held"), trusted.where("held")) if all(filled) else (trusted, trusted)
    counts = stored(gram_counts(trained))
    apart = stored(held.select("lang", "text"))
    dropped(trusted)
    grams, contexts, unseen = kneser_ney(counts)
    dropped(counts)
    head = docs.sparkSession.sparkContext.broadcast(head_of(grams[ORDER], HEAD))
    return Model(grams, contexts, unseen, head), apart


def held_out(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(HELD)) == 0


def judged(docs: DataFrame, labels: DataFrame, quantile: float, margin: float, deviations: float) -> DataFrame:
    """The columns of docs but for text, with perplexity and kept; docs: text, lang without nulls and others, labels as in quality_lm."""
    model, held = fit(docs, labels)
    ppl = stored(perplexities(held, model, 0.0).where("perplexity IS NOT NULL"))
    dropped(held)
    q, x = F.percentile_approx("perplexity", quantile, 100_000), F.ln("perplexity")
    overall = ppl.agg(q).first()[0]
    own = stored(ppl.groupBy("lang").agg(F.ln(q).alias("_own"), F.count("*").alias("_n"), (F.var_pop(x) * F.count("*")).alias("_squares")))
    scored = perplexities(docs, model, deviations)
    if overall is None:
        return scored.withColumn("kept", F.col("perplexity").isNotNull()).drop("low")
    every, squares = own.agg(F.sum("_n"), F.sum("_squares")).first()
    n, shared = F.coalesce("_n", F.lit(0)), F.lit(math.log(overall))
    error = F.lit(math.sqrt(squares / every)) / F.sqrt(F.least(F.lit(every), n + POOLED))
    limit = F.exp((n * F.coalesce("_own", F.lit(0.0)) + POOLED * shared) / (n + POOLED) + ERRORS * error) * margin
    return scored.join(own, "lang", "left").withColumn("kept", F.coalesce(F.col("low") <= limit, F.lit(False))).drop("_own", "_n", "_squares", "low")


def quality_lm(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, deviations: float = DEVIATIONS) -> DataFrame:
    """doc_id, lang, perplexity (a character) and kept of each document.

    docs: doc_id, text, lang; labels: doc_id, quality; other columns are not read. Null and empty texts have no
    perplexity and are not kept. A null lang counts as a language of its own, as an empty one. A document is kept
    unless its perplexity is over the quantile of its language's held-out trusted documents, which is drawn towards the
    quantile of all and raised by ERRORS standard errors, both of which matter only where these are few; margin and deviations loosen that, at 1 and 0 they do nothing. Without trusted
    documents all texts with a character are kept. Repeated rows each give a row and count as often in training. Empty
    tables give no rows.
    """
    own = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("lang").cast("string").alias("own_lang"), F.col("text").cast("string").alias("text"))
    return judged(own, labels, quantile, margin, deviations).select("doc_id", F.col("own_lang").alias("lang"), "perplexity", "kept")


def kept_only(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, deviations: float = DEVIATIONS) -> DataFrame:
    """The rows of docs that quality_lm keeps, as they are; the verdict depends on text and lang alone."""
    text, lang = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.octet_length(lang).cast("string"), F.lit(" "), lang, text), 256)
    rows = docs.select(F.col("doc_id"), lang.alias("lang"), key.alias("key"), F.col("text").cast("string").alias("text"))
    gone = judged(rows, labels, quantile, margin, deviations).where("NOT kept").select(F.col("key").alias("_key")).distinct()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    return marked.join(stored(gone), "_key", "left_anti").select("_row.*")
