import math
import random
from collections import Counter

import numpy as np
import pytest
from gradecube.llm import quality_lm as Q


def brute(texts):
    """Interpolated modified Kneser-Ney by plain dictionaries; gives the probability of the last character of a string."""
    grams = {Q.ORDER: Counter()}
    for t in texts:
        s = Q.START * (Q.ORDER - 1) + t
        grams[Q.ORDER].update(s[i : i + Q.ORDER] for i in range(len(t)))
    for k in range(Q.ORDER - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    ds, totals, masses = {}, {}, {}
    for k, g in grams.items():
        n = [sum(1 for c in g.values() if c == j) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        ds[k] = [min(j - 0.05, max(0.05, j - (j + 1) * y * n[j] / n[j - 1])) if n[j - 1] else j / 2 for j in (1, 2, 3)]
        totals[k], masses[k] = Counter(), Counter()
        for x, c in g.items():
            totals[k][x[:-1]] += c
            masses[k][x[:-1]] += min(c, ds[k][min(c, 3) - 1])

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(grams[1]) + 1)
        total = totals[k][g[:-1]]
        if not total:
            return p(g[1:])
        c = grams[k][g]
        own = max(0, c - ds[k][min(c, 3) - 1]) if c else 0
        return own / total + masses[k][g[:-1]] / total * p(g[1:])

    return p, sorted(grams[1])


def losses(p, t):
    s = Q.START * (Q.ORDER - 1) + t
    return np.array([-math.log(p(s[i : i + Q.ORDER])) for i in range(len(t))])


@pytest.mark.parametrize(("head", "margin", "deviations"), [(0, 1.0, 0.0), (40, 1.0, 0.0), (1 << 16, 1.05, 2.0)])
def test_whole_documents_match_brute_force(spark, monkeypatch, head, margin, deviations):
    """Perplexities, limits and verdicts, however much of the model is sent to the executors."""
    monkeypatch.setattr(Q, "HEAD", head)
    monkeypatch.setattr(Q, "PIECE", 37)
    rnd = random.Random(1)
    letters = {"en": "abcde .", "ru": "абвгд .", None: "abc日本"}
    rows = []
    for k in range(150):
        lang = rnd.choice(["en", "ru", "ru", None])
        odd = rnd.random() < 0.15
        rows.append((k, "".join(rnd.choices("xyz%&😀" if odd else letters[lang], k=rnd.randint(0, 90))), lang))
    rows += [(200, None, "en"), (201, "", "ru"), (7, rows[7][1], rows[7][2]), (None, "abc de", "xx")]
    labels = [(k, 1 if k % 3 else 0) for k in range(0, 120)]
    docs = spark.createDataFrame([(i, t, la, 1.5, "r") for i, t, la in rows], "doc_id long, text string, lang string, perplexity double, rest string")
    out = Q.quality_lm(docs, spark.createDataFrame(labels, "doc_id long, quality int"), 0.8, margin, deviations).collect()
    good = {i for i, q in labels if q == 1}
    trusted = [(t or "", la or "") for i, t, la in rows if i in good]
    held = {r.t for r in spark.createDataFrame([(t,) for t, _ in trusted], "t string").where(Q.held_out(Q.F.col("t"))).collect()}
    assert 5 < len(held) < len(trusted) / 2
    p, symbols = brute([t for t, _ in trusted if t not in held])
    assert abs(sum(p("bcd"[1 - Q.ORDER :] + c) for c in [*symbols, "\x00"]) - 1) < 1e-9
    ppl = lambda t: math.exp(losses(p, t).mean()) if t else None
    quantile = lambda v: sorted(v)[max(0, math.ceil(0.8 * len(v)) - 1)]
    by = {}
    for t, la in trusted:
        if t in held and t:
            by.setdefault(la, []).append(ppl(t))
    overall = quantile([x for v in by.values() for x in v])
    every = sum(map(len, by.values()))
    sd = math.sqrt(sum(np.var(np.log(v)) * len(v) for v in by.values()) / every)
    error = lambda v: sd / math.sqrt(min(every, len(v) + Q.POOLED))
    pooled = lambda v: math.exp((len(v) * math.log(quantile(v) if v else 1) + Q.POOLED * math.log(overall)) / (len(v) + Q.POOLED) + Q.ERRORS * error(v)) * margin
    want = Counter()
    for i, t, la in rows:
        x = losses(p, t or "")
        low = math.exp(x.mean() - deviations * x.std() / math.sqrt(len(x))) if len(x) else None
        want[i, la, round(ppl(t), 6) if t else None, low is not None and low <= pooled(by.get(la or "", []))] += 1
    got = Counter((r.doc_id, r.lang, None if r.perplexity is None else round(r.perplexity, 6), r.kept) for r in out)
    assert got == want and len({k[3] for k in want}) == 2


def test_keeps_prose_drops_junk_and_odd_rows(spark):
    rnd = random.Random(2)
    prose = lambda n: " ".join(rnd.choices("the cat sat on a mat and saw the dog run home".split(), k=n)) + "."
    rows = [(k, prose(rnd.randint(20, 60)), "en") for k in range(120)] + [(k, "%%% ### &&& " * 20, "en") for k in range(120, 140)]
    rows += [(140, None, "en"), (141, "", None), (142, prose(30), None), (143, "日本語のテキスト" * 30, "ja"), (None, prose(20000), "en"), (5, prose(40), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*((k, 1) for k in range(0, 100)), (130, 0), (3, 1), (None, 1), (8, None)], "doc_id long, quality int")
    out = Q.quality_lm(docs, labels).collect()
    assert len(out) == len(rows)
    kept = Counter(r.doc_id for r in out if r.kept)
    assert sum(kept[k] for k in range(120)) >= 117 and not any(kept[k] for k in range(120, 142)) and kept[142] and kept[None]
    same = Q.kept_only(docs, labels)
    assert same.columns == docs.columns and Counter(r.doc_id for r in same.collect()) == kept


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in Q.quality_lm(docs, none).collect()] == [True]
    assert Q.quality_lm(docs.limit(0), none).count() == 0
    assert Q.kept_only(docs.limit(0), none).count() == 0
