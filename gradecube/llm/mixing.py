"""Operator 8: document rates whose expected token totals by domain match target weights.

A naive Bayes classifier learnt from a labelled table gives each document the posterior of each domain. Rates r >= 0
then minimise the squared error of the expected totals, sum of r * tokens * posterior against the targets, by
accelerated projected gradient. All of it is DataFrame expressions: the gradient needs one row of sums a step, and as
a rate depends on the posterior alone, steps run on one row for each kind of document rather than each document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The classifier learns from at most this many labelled rows of each domain, those with the least hash of doc_id.
MOST_ROWS = 4000
#: Words whose presence tells domains apart, at most; they need this many labelled documents of one domain.
#: and a share of its documents this many times that of any other domain.
MOST_WORDS, LEAST_SUPPORT, LEAST_RATIO = 150, 8, 4.0
#: The descent ends when a step moves no domain's share of the tokens by more than TOLERANCE, or after MOST_STEPS.
MOST_STEPS, TOLERANCE, STORE_EVERY, PULL = 96, 1e-6, 12, 1e-3
SYMBOLS, CAPITALS, ENDS = r"[#*$%&|<>@=+/\\_~^]", "[A-Z]", "[!?]"
#: Tokens are parted by blanks and these marks.
GAP = r"[\x20\x09-\x0D.,;:!?()\"]+"
#: Feature bins: name, number of bins.
HITS = 5
BINS = {"symbols": 8, "capitals": 8, "ends": 8, "word_length": 10, "variety": 10, "length": 16}
TARGETS = {"clean": 0.9, "junk": 0.06, "toxic": 0.04}


@dataclass
class Mix:
    """What fit() has learnt: all of bounded size."""

    domains: list[str]
    prior: list[float]
    lexicon: list[list[str]] = field(default_factory=list)  #: the words of each domain
    bins: list[list[list[float]]] = field(default_factory=list)  #: log share of each bin, by feature and domain
    history: list[list[float]] = field(default_factory=list)


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain from labels of quality and toxicity; a row without labels has no domain."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", name.alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def binned(share: Column, bins: int, scale: float) -> Column:
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.coalesce(share, F.lit(0.0)) * scale))).cast("int")


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def featured(docs: DataFrame, lexicon: list[list[str]], keep: list[str]) -> DataFrame:
    """The columns keep, n_tokens and bins: an array in the order of BINS, then how many words of each domain's are met."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(*keep, text.alias("_t"))
    share = lambda chars: F.regexp_count("_t", F.lit(chars)) / F.nullif(F.length("_t"), F.lit(0))
    d = d.select(*keep, F.length("_t").alias("_n"), share(SYMBOLS).alias("_s"), share(CAPITALS).alias("_c"), share(ENDS).alias("_e"), tokens(F.col("_t")).alias("_w"))
    known = F.array(*[F.lit(w) for ws in lexicon for w in ws]) if any(lexicon) else F.array().cast("array<string>")
    counts = [*keep, "_n", "_s", "_c", "_e"]
    d = d.select(*counts, F.size("_w").alias("_k"), F.array_distinct("_w").alias("_u")).select(*counts, "_k", F.size("_u").alias("_d"), F.array_intersect("_u", known).alias("_h"))
    n = F.col("_k")
    bins = F.array(
        binned(F.col("_s"), BINS["symbols"], 40.0),
        binned(F.col("_c"), BINS["capitals"], 20.0),
        binned(F.col("_e"), BINS["ends"], 40.0),
        binned(F.col("_n") / F.nullif(n, F.lit(0)), BINS["word_length"], 1.0),
        binned(F.col("_d") / F.nullif(n, F.lit(0)), BINS["variety"], 10.0),
        binned(F.log2(n + 1.0), BINS["length"], 1.0),
    )
    hits = [F.least(F.lit(HITS - 1), F.size(F.array_intersect("_h", F.array(*map(F.lit, ws))))) if ws else F.lit(0) for ws in lexicon]
    return d.select(*keep, n.cast("long").alias("n_tokens"), F.concat(bins, F.array(*hits)).alias("bins") if hits else bins.alias("bins"))


def learn_words(sample: DataFrame, sizes: dict[str, int]) -> list[list[str]]:
    """The words that tell most about each domain, by the gain of their presence."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = sample.select("domain", F.explode(F.array_distinct(tokens(text))).alias("w")).groupBy("w").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(sizes)])
    rates = [(F.col(f"n{k}") + 0.5) / (n + 1.0) for k, n in enumerate(sizes.values())]
    overall = sum(rates[1:], rates[0]) / len(rates)
    gain = sum((r * F.log(r / overall) for r in rates[1:]), rates[0] * F.log(rates[0] / overall))
    enough = F.greatest(F.lit(0), *[F.col(f"n{k}") for k in range(len(sizes))]) >= LEAST_SUPPORT
    by_rate = F.sort_array(F.array(*rates), asc=False)
    if len(rates) > 1:
        enough = enough & (F.get(by_rate, 0) >= LEAST_RATIO * F.get(by_rate, 1))
    owner = F.array_position(F.array(*rates), F.get(by_rate, 0)) - 1
    top = counts.where(enough).select("w", owner.alias("k"), F.round(gain, 12).alias("g")).orderBy(F.desc("g"), "w").limit(MOST_WORDS).collect()
    return [[r.w for r in top if r.k == k] for k in range(len(sizes))]


def learn(docs: DataFrame, domains: DataFrame, names: list[str]) -> Mix:
    """The classifier, from a bounded sample of each domain; priors are the shares of all labelled rows."""
    sizes = {r.domain: r.n for r in domains.where(F.col("domain").isin(names)).groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    mix = Mix(names, [(sizes.get(d, 0) + 1.0) / (total + len(names)) for d in names])
    if not total:
        return mix
    ids = None
    for d in names:
        part = domains.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_ROWS)
        ids = part if ids is None else ids.unionByName(part)
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))  # ids are at most MOST_ROWS a domain
    n = {d: 0 for d in names} | {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    mix.lexicon = learn_words(sample, n)
    f = stored(featured(sample, mix.lexicon, ["domain"]))
    of_bins = f.select("domain", F.posexplode("bins").alias("f", "b")).groupBy("domain", "f", "b").agg(F.count("*").alias("n")).collect()
    got = {(r.domain, r.f, r.b): r.n for r in of_bins}
    for k, size in enumerate([*BINS.values(), *[HITS] * len(names)]):
        mix.bins.append([[math.log((got.get((d, k, b), 0) + 0.5) / (n[d] + 0.5 * size)) for b in range(size)] for d in names])
    return mix


def with_posteriors(rows: DataFrame, mix: Mix, name: str = "p") -> DataFrame:
    """rows with the array of domain posteriors from bins, in steps that keep the plan small."""
    logs = []
    for k, prior in enumerate(mix.prior):
        x = F.lit(math.log(prior))
        for j, table in enumerate(mix.bins):
            x = x + F.get(F.array(*map(F.lit, table[k])), F.get("bins", j))
        logs.append(x)
    out = rows.withColumn(name, F.array(*logs))
    out = out.withColumn(name, F.transform(name, lambda x: F.exp(x - F.array_max(name))))
    return out.withColumn(name, F.transform(name, lambda x: F.round(x / F.aggregate(name, F.lit(0.0), lambda a, y: a + y), 6)))


def rate(history: list[list[float]], p: Column, start: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """The rate after the steps of history, and the point that the next step looks from; each step has the gradient of each domain and its momentum."""
    r0, y0 = start or (F.lit(1.0), F.lit(1.0))
    if not history:
        return r0, y0
    size = len(history[0]) - 1
    steps = F.array(*[F.array(*map(F.lit, h)) for h in history])

    def step(acc: Column, h: Column) -> Column:
        pull = sum((F.get(h, k) * F.get(p, k) for k in range(1, size)), F.get(h, 0) * F.get(p, 0))
        r = F.greatest(F.lit(0.0), acc["y"] - (pull + PULL * (acc["y"] - 1.0)) / (1.0 + PULL))
        return F.struct(r.alias("r"), (r + F.get(h, size) * (r - acc["r"])).alias("y"))

    out = F.aggregate(steps, F.struct(r0.alias("r"), y0.alias("y")), step)
    return out["r"], out["y"]


def solve(kinds: DataFrame, targets: list[float]) -> list[list[float]]:
    """The steps of the descent over kinds (p, tokens): each reads one row of sums.

    Squared errors are weighed by the inverse of the posteriors' second moments, which makes all directions alike.
    """
    size = len(targets)
    first = kinds.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.get("p", j) * F.get("p", k)) for j in range(size) for k in range(size)]).first()
    total = float(first[0] or 0)
    if not total:
        return []
    weigh = np.linalg.inv(np.array([float(x) / total for x in first[1:]]).reshape(size, size) + 1e-6 * np.eye(size))
    goal = np.array(targets) / sum(targets)
    history: list[list[float]] = []
    state = stored(kinds.select("p", "tokens", F.lit(1.0).alias("r"), F.lit(1.0).alias("y")))
    recent: list[list[float]] = []
    t, before = 1.0, None
    for _ in range(MOST_STEPS):
        _, y = rate(recent, F.col("p"), (F.col("r"), F.col("y")))
        sums = state.select("tokens", "p", y.alias("y")).agg(*[F.sum(F.col("y") * F.col("tokens") * F.get("p", j)) for j in range(size)]).first()
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        shares = np.array([float(x) for x in sums]) / total
        if before is not None and np.abs(shares - before).max() <= TOLERANCE:
            break
        before = shares
        step = [*map(float, weigh @ (shares - goal)), (t - 1) / after]
        t = after
        history.append(step)
        recent.append(step)
        if len(recent) == STORE_EVERY:
            r, y = rate(recent, F.col("p"), (F.col("r"), F.col("y")))
            state = stored(state.select("p", "tokens", r.alias("r"), y.alias("y")))
            recent = []
    return history


def fit(docs: DataFrame, domains: DataFrame, targets: dict[str, float], keep: list[str]) -> tuple[Mix, DataFrame]:
    """What was learnt, and the columns keep, n_tokens, p of each document, stored."""
    names = sorted(targets)
    mix = learn(docs, domains, names)
    rows = stored(with_posteriors(featured(docs, mix.lexicon, keep), mix).select(*keep, "n_tokens", "p"))
    kinds = rows.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("tokens"))
    mix.history = solve(kinds, [targets[d] for d in names])
    return mix, rows


def finished(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows with p as columns p_<domain>, and rate."""
    r, _ = rate(mix.history, F.col("p"))
    out = rows.withColumn("rate", r)
    for k, d in enumerate(mix.domains):
        out = out.withColumn(f"p_{d}", F.get("p", k))
    return out.drop("p")


def mixing(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, n_tokens, rate and the posterior p_<domain> of each document.

    docs: doc_id, text and, if it has one, source; domains: doc_id, domain; targets: weight of each domain, in any
    unit. Other columns are not read; labels of other domains count for nothing. Null and empty texts have no
    tokens, a posterior from that, and a rate that moves no total. Without labels all posteriors are alike. Targets
    out of reach are met as nearly as nonnegative rates allow. Repeated rows each give a row; empty tables none.
    The classifier has bounds of its own: it learns from at most MOST_ROWS labelled rows a domain, and counts up to
    HITS - 1 of each domain's words, of which it knows MOST_WORDS in all.
    """
    mix, rows = fit(docs, domains, TARGETS if targets is None else targets, [c for c in ("doc_id", "source") if c in docs.columns])
    return finished(rows, mix)


def copies(rate: Column, doc_id: Column, seed: str = "mix") -> Column:
    """A whole number of copies whose expectation is the rate, drawn from a hash of doc_id."""
    draw = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame, domains: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with rate and copies beside their columns, without the documents that get no copy.

    Columns pass unchanged; where docs has a column rate or copies, the new one's name ends in an underscore. Null and
    empty texts have a rate like others and move no total; a null doc_id draws like any one id, so all rows without one
    round alike, as do repeated rows. Empty tables give no rows.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "doc_id")
    mix, rows = fit(packed, domains, TARGETS if targets is None else targets, ["_row", "doc_id"])
    r, _ = rate(mix.history, F.col("p"))
    names = {}
    for name in ("rate", "copies"):
        names[name] = name
        while names[name] in docs.columns:
            names[name] += "_"
    out = rows.select("_row", "doc_id", r.alias("_rate")).withColumn("_copies", copies(F.col("_rate"), F.col("doc_id")))
    return out.where("_copies > 0").select("_row.*", F.col("_rate").alias(names["rate"]), F.col("_copies").alias(names["copies"]))
