"""Operator 11: spelling variants of frequent words by a rare-first q-gram prefix filter.

One edit destroys at most two of a word's bigrams. So of two words one edit apart, the three rarest bigrams of each, in
one global order by frequency, hold a bigram that the edit has left alone, at places that differ by one at most. Only
these three go into the join.

The edit lies wholly after that bigram or wholly before it, so the words are alike up to the bigram, or from it on. It
lies, too, in one half of what is left, so the other half is alike. Both go into the join key beside the bigram. That
holds for every pair one edit apart, so none is lost, and a frequent bigram is no hot key: only words that share all but
some letters in one place meet. What meets is settled by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of at least so many code points and occurrences; a form is at least so many times as frequent as its variant.
LEAST, SEEN, RATIO = 6, 5, 5
#: The rarest bigrams of a word that are joined: one edit destroys two, so one of three is left.
RAREST = 3
#: So many bigrams are sent to all tasks, more are joined by shuffle; Latin letters make 8,100.
FEW_BIGRAMS = 1 << 15


def typed(word: Column, doc_id: Column, every: int) -> Column:
    """The word without the code point h % length where every divides h, the crc32 of id and word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def words_of(docs: DataFrame, least: int = LEAST, seen: int = SEEN, slip_every: int | None = None) -> DataFrame:
    """word, n of the runs of Latin letters in all texts, A to Z lower-cased; with slip_every a share of runs loses a letter."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}+"), 0)).alias("raw"))
    low = F.when(F.lower("raw") == F.col("raw"), F.col("raw")).otherwise(F.translate("raw", UPPER, UPPER.lower()))
    words = runs.select("doc_id", low.alias("word"))
    if slip_every:
        words = words.select(typed(F.col("word"), F.col("doc_id"), slip_every).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """word, n, at (from 1): the places of the three rarest bigrams of each word, ties by bigram and place."""
    grams = words.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))).alias("at", "gram"))
    common = stored(grams.groupBy("gram").agg(F.count("*").alias("f")))
    if common.count() <= FEW_BIGRAMS:
        common = F.broadcast(common)
    first = F.slice(F.sort_array(F.collect_list(F.struct("f", "gram", "at"))), 1, RAREST)
    rare = grams.join(common, "gram").groupBy("word", "n").agg(first.alias("rare"))
    return rare.select("word", "n", F.explode("rare.at").alias("pos")).select("word", "n", (F.col("pos") + 1).alias("at"))


def keys(rare: DataFrame) -> DataFrame:
    """word, n, longer, key: what a word one edit away has too, if it is no shorter (longer false) or shorter (true).

    side: 0 if the edit is after the bigram, 1 if before; m: letters that the shorter of both has on that side.
    """
    length, at = F.length("word"), F.col("at")
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    rows = rare.select("word", "n", "at", sides)
    alike = F.when(F.col("side") == 0, F.substring("word", F.lit(1), at + 1)).otherwise(F.substring("word", at, length))
    rest = F.when(F.col("side") == 0, F.substring("word", at + 2, length)).otherwise(F.substring("word", F.lit(1), at - 1))
    rows = rows.select("word", "n", "side", alike.alias("alike"), rest.alias("rest"))
    rows = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")).withColumn("m", F.length("rest") - F.col("longer").cast("int")).where("m >= 0")
    half = F.floor(F.col("m") / 2).cast("int")
    front = F.struct(F.lit(0).alias("part"), F.substring("rest", F.lit(1), half).alias("text"))
    back = F.struct(F.lit(1).alias("part"), F.substring("rest", F.length("rest") - (F.col("m") - half) + 1, F.length("rest")).alias("text"))
    rows = rows.select("word", "n", "side", "alike", "longer", "m", F.explode(F.array(front, back)).alias("half"))
    return rows.select("word", "n", "longer", F.xxhash64("side", "alike", "m", "half.part", "half.text").alias("key"))


def near_words(words: DataFrame) -> DataFrame:
    """a, an, b, bn: each pair of words one edit apart, both ways."""
    rows = stored(keys(rarest_bigrams(words)))
    a = rows.where("NOT longer").select(F.col("word").alias("a"), F.col("n").alias("an"), "key")
    b = rows.select(F.col("word").alias("b"), F.col("n").alias("bn"), "longer", "key")
    met = a.join(b, "key").where(F.when(F.col("longer"), F.length("b") == F.length("a") + 1).otherwise((F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))))
    pairs = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn").distinct()
    out = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn"))))
    dropped(rows)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms; each round doubles what is followed, and counts at least quintuple."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = stored(now.join(on, "root", "left"))
        if not further.where("further IS NOT NULL").head(1):
            return now
        now = stored(further.select("word", F.coalesce("further", "root").alias("root")))


def spelling_variants(docs: DataFrame, least: int = LEAST, seen: int = SEEN, ratio: int = RATIO, slip_every: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of at least `least` code points that occurs at least `seen` times.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its most frequent near word
    (ties: least in code-point order) if that is at least `ratio` times as frequent; root is the end of its chain of
    forms, or the word itself. Input: doc_id, text; other columns are not read. Null and empty texts have no words;
    repeated rows count again; a null doc_id counts as empty in slip_every, which makes one run in so many lose a code
    point. Texts of any length are read whole. Empty tables give no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or chains of forms need not end")
    words = stored(words_of(docs, least, seen, slip_every))
    near = near_words(words)
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form"))).alias("best"))
    judged = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(-F.col("best.less") >= ratio * F.col("n"), c).alias(name) for name, c in (("form", F.col("best.form")), ("form_n", -F.col("best.less")))]))
    out = judged.join(roots(judged.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of the UTF-8 bytes of a text in DuckDB, bit by bit; 3988292384 is the reversed polynomial."""
    hexed = f"hex(encode({text}))"
    bits = f"flatten(list_transform(range(octet_length(encode({text}))), lambda k: [('0x' || substr({hexed}, 2 * k + 1, 2))::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::bigint), 4294967295)"


ORACLE = rf"""WITH RECURSIVE runs AS (SELECT doc_id, translate(run, '{UPPER}', '{UPPER.lower()}') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) r),
per AS (SELECT w, h, count(*) AS c FROM (SELECT w, doc_id, count(*) AS many FROM runs WHERE length(w) >= {LEAST} GROUP BY 1, 2) g,
  LATERAL (SELECT {crc32_sql("concat(doc_id::varchar, ':', w)")} AS h) x, LATERAL (SELECT unnest(range(many))) y GROUP BY 1, 2),
words AS (SELECT word, sum(c)::bigint AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(w, 1, (h % length(w))::int), substr(w, (h % length(w))::int + 2)) ELSE w END AS word, c FROM per) s
  WHERE length(word) >= {LEAST} GROUP BY 1 HAVING sum(c) >= {SEEN}),
cut AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
less AS (SELECT word, n, i, concat(substr(word, 1, i::int), substr(word, i::int + 2)) AS rest FROM cut),
pairs AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT a AS word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY 1),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * w.n THEN (SELECT min(b) FROM pairs p WHERE p.a = w.word AND p.n = most) END AS form, CASE WHEN most >= {RATIO} * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word),
chain AS (SELECT word, word AS at, form AS nxt FROM judged UNION ALL SELECT c.word, c.nxt, j.form FROM chain c JOIN judged j ON j.word = c.nxt)
SELECT j.word, j.form, c.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN chain c ON c.word = j.word AND c.nxt IS NULL"""
