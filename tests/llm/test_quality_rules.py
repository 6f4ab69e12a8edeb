import random
import re
from collections import Counter

from gradecube.llm import quality_rules as Q

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    ws = GAP.findall(text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if GAP.search(x)]
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_match_plain_python(spark):
    rnd = random.Random(8)
    words = ["a", "bb", "the", "É", "#x", "%", "naïve"]
    texts = [None, "", " \t\n\x0b\x0c\r ", "one two", "a b c d e " * 3, "x\n\nx\n x\n", "same line\n" * 5, "𝒳 😀 é" * 4, "w " * 60000, "a b c d e f a b c d e", "end\n"]
    for _ in range(120):
        texts.append("".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rnd.randint(0, 60))))
    rows = [(k % 100 if k else None, t, rnd.choice(["en", "fr", None, "xx"]), -1) for k, t in enumerate(texts)]
    out = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((k % 100 if k else None, *plain(t)) for k, t in enumerate(texts))
    assert not any(r.kept and r.base_failed for r in out)


def test_verdict(spark):
    prose = "The cat sat on the mat and it was warm in the sun for all of us at home by then"
    junk = ["%%% " + "### ".join(f"w{k}" for k in range(30)), "!! ".join(f"W{k}" for k in range(30)), " ".join(f"zq{k}x" for k in range(30)), "\n".join(["a new line of some length"] * 12)]
    rows = [(0, prose, "en"), (1, prose, None), (2, "alpha beta gamma delta " + " ".join(f"w{k}" for k in range(9)), "xx")] + [(k, t, "en") for k, t in enumerate(junk, 3)]
    kept = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert Q.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
