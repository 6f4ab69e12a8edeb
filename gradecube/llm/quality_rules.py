"""Operator 7: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Frequent function words, by language.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be at by this from or an a",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es",
    "fr": "de la le et les des en un du une que est pour qui dans sur par pas au avec",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como",
}
#: One row a rule: name, numerator, denominator, least and most allowed ratio (None: no bound).
#: A rule whose denominator is 0 holds. "stops" holds for languages without a list.
RULES = [
    ("length", "n_words", None, 10, 1_000_000),
    ("word_length", "word_chars", "n_words", 2.0, 20.0),
    ("symbols", "n_symbols", "n_words", None, 0.25),
    ("exclamations", "n_bangs", "n_words", None, 0.5),
    ("stops", "n_stops", "n_words", 0.03, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("bullet_lines", "n_bullets", "n_lines", None, 0.9),
    ("ellipsis_lines", "n_ellipses", "n_lines", None, 0.5),
]
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW = 5


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def compiled(rules: list[tuple]) -> Column:
    """One boolean: every rule holds."""
    verdict = F.lit(True)
    for _, top, base, least, most in rules:
        x = F.col(top).cast("double")
        x = x if base is None else x / F.nullif(F.col(base), F.lit(0))
        for bound in ([x >= least] if least is not None else []) + ([x <= most] if most is not None else []):
            verdict = verdict & F.coalesce(bound, F.lit(True))
    return verdict


def stops_in(ws: Column, known: list[str]) -> Column:
    return F.size(F.filter(ws, lambda x: F.lower(F.translate(x, ".,;:!?", "")).isin(known)))


def repeated_words(hashes: Column, size: int = WINDOW) -> tuple[Column, Column]:
    """From the hashes of a text's windows: the sorted (hash, place) pairs, needed where one occurs twice, and the places of repeated windows made from them."""
    pairs = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    p = F.col("_pairs")
    last = F.size(p) - 1
    at = lambda k: F.get(p, k)["h"]
    same = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & (at(k) == at(k - 1))) | ((k < last) & (at(k) == at(k + 1))))
    return pairs, F.array_sort(F.transform(same, lambda k: F.get(p, k)["i"]))


def covered(places: Column, size: int = WINDOW) -> Column:
    """How many words the windows at these ascending places cover."""
    step = lambda acc, p: F.struct((p + size).alias("end"), (acc["n"] + size - F.greatest(F.lit(0), acc["end"] - p)).alias("n"))
    return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def quality_rules(docs: DataFrame, rules: list[tuple] | None = None, stop_words: dict[str, str] | None = None) -> DataFrame:
    """Counts and verdict of each document, in one narrow plan without a shuffle.

    Input: doc_id, text, lang; other columns are not read. A null text counts as an empty one, a null or
    unknown lang has no stop-word rule. Empty tables give no rows; repeated rows each give a row. Texts of
    any length are read whole; each is one row's arrays in memory. Returns doc_id, the counts, base_failed, kept.
    """
    stop_words = stop_words or STOP_WORDS
    text = F.col("text")
    d = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), F.lower(F.coalesce(F.col("lang"), F.lit(""))).alias("lang"))
    d = d.withColumn("_w", words(text)).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    n = F.size("_w")
    w = F.col("_w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    stops = F.lit(None)
    for lang, known in stop_words.items():
        stops = F.when(F.col("lang") == lang, stops_in(w, sorted(set(known.split())))).otherwise(stops)
    d = d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        count_of(text, "!").alias("n_bangs"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike("^[-*•·]"))).alias("n_bullets"),
        F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipses"),
        stops.alias("n_stops"),
        windows.alias("_h"),
    )
    pairs, places = repeated_words(F.col("_h"))
    d = d.withColumn("_pairs", pairs).withColumn("_places", F.when(F.col("_pairs").isNotNull(), places))
    d = d.withColumn("n_repeat_words", F.coalesce(covered(F.col("_places")), F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & compiled(rules or RULES))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _stops_sql() -> str:
    return " ".join(f"WHEN lower(coalesce(lang, '')) = '{lang}' THEN len(list_filter(ws, lambda x: lower(translate(x, '.,;:!?', '')) IN ({', '.join(repr(x) for x in sorted(set(known.split())))})))" for lang, known in STOP_WORDS.items())


def _rules_sql() -> str:
    bounds = []
    for _, top, base, least, most in RULES:
        x = f"{top}::DOUBLE" + (f" / nullif({base}, 0)" if base else "")
        bounds += [f"coalesce({x} >= {least}, true)"] if least is not None else []
        bounds += [f"coalesce({x} <= {most}, true)"] if most is not None else []
    return " AND ".join(bounds)


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM rep, (SELECT unnest(range(0, 5)) AS k)) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         length(t) - length(replace(t, '!', '')) AS n_bangs,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^ *[-*•·]'))) AS n_bullets,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS n_ellipses,
         CASE {_stops_sql()} END AS n_stops, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules_sql()} AS kept FROM b
"""
