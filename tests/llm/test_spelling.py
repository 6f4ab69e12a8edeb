import random
import re
import zlib
from collections import Counter

import pytest
from gradecube.llm import spelling as S


def lowered(run):
    return re.sub("[A-Z]", lambda m: m[0].lower(), run)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, slip=None, least=6, seen=5, ratio=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= seen}
    out, form = {}, {}
    for w in n:
        near = [v for v in n if one_apart(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
        out[w] = len(near)
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return sorted((w, form[w] or "", root[w], n[w], out[w], n.get(form[w])) for w in n)


def made(seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choices("abcéß", k=rnd.randint(5, 12))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "babababab"]
    words = []
    for stem in stems:
        weight = 5 ** rnd.randint(1, 3)
        words += [stem] * weight
        for _ in range(6):
            k = rnd.randrange(len(stem))
            kind = rnd.randrange(3)
            words += [stem[:k] + ("" if kind == 0 else rnd.choice("abcdeé")) + stem[k + (kind != 1) :]] * rnd.choice([1, 5, 6, 30])
    rnd.shuffle(words)
    return [(k, rnd.choice([" ", ", ", "_", "1"]).join(w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in words[k::40])) for k in range(40)]


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize(("seed", "slip"), [(1, None), (2, 7), (3, 199)])
def test_matches_brute_force(spark, seed, slip):
    rows = made(seed)
    want = brute(rows, slip)
    assert any(w[1] for w in want) and any(w[4] > 1 for w in want)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n long".replace("n long", "word string"))
    assert got(S.spelling_variants(df, slip_every=slip)) == want


def test_every_single_edit_is_met(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choices("ab", k=k)) for k in range(6, 14)] + ["aaaaaaaaa", "abcabcabc"]
    words = set(base)
    for w in base:
        for k in range(len(w) + 1):
            words |= {w[:k] + "x" + w[k:], w[:k] + "a" + w[k:], w[:k] + w[k + 1 :], w[:k] + "b" + w[k + 1 :]}
    words = sorted(words)
    pairs = {(a, b) for a in words for b in words if one_apart(a, b)}
    near = S.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    assert {(r.a, r.b) for r in near.collect()} == pairs


def test_chain_of_forms(spark):
    words = {"kettle": 1, "kettles": 6, "kettless": 31, "kettlesss": 200}
    df = spark.createDataFrame([(1, " ".join(w for w, n in words.items() for _ in range(n * 5)))], "doc_id long, text string")
    out = {r.word: (r.form, r.root) for r in S.spelling_variants(df).collect()}
    assert out == {"kettle": ("kettles", "kettlesss"), "kettles": ("kettless", "kettlesss"), "kettless": ("kettlesss", "kettlesss"), "kettlesss": (None, "kettlesss")}


def test_odd_rows(spark):
    rows = [(1, None), (None, "letter " * 5), (2, ""), (3, "x" * 50_000 + " " + "Letters " * 30), (3, "Letters"), (4, "Übung übung " * 6), (5, "short " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(S.spelling_variants(df)) == brute(rows)
    assert S.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="twice"):
        S.spelling_variants(df, ratio=1)
