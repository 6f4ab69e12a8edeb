import re
import textwrap

from gradecube.llm import license_scan as L


def grams(text):
    ws = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return set(zip(ws, ws[1:])) if len(ws) > 1 else set(ws)


def dice(a, b):
    a, b = grams(a), grams(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0


def test_bounds_never_rule_out_a_match():
    for a in range(1, 60):
        for b in range(1, 60):
            low, high = L.size_bounds(b, 0.8)
            if 2 * min(a, b) / (a + b) >= 0.8:
                assert low <= a <= high


def test_segments_against_plain_dice(spark):
    mit = L.TEMPLATES[2][1]
    wrapped = "\n".join(textwrap.wrap(mit, 60))
    half = mit.split(",")[0]
    texts = [None, "", "Prose.\nReleased under the MIT License.\nMore prose.", "Licensed under CC BY-NC 4.0.", wrapped, "Intro text\n\n" + wrapped + "\n\nOutro", half, "license", "released UNDER the mit-license!", "word " * 50000 + "\nLicensed under the Apache License, Version 2.0", "Licensed under the Apache Licence, Version 3.0"]
    rows = [(k, t, 0.1) for k, t in enumerate(texts)] + [(3, texts[3], 0.2), (None, texts[3], 0.3)]
    out = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string, dice double")).collect()
    got = {(r.doc_id, r.segment, r.license): r.dice for r in out}
    for k, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            best = {}
            for name, template in L.TEMPLATES:
                if (x := dice(line, template)) >= L.THRESHOLD:
                    best[name] = max(best.get(name, 0), x)
            assert {key[2]: v for key, v in got.items() if key[:2] == (k, n)} == best
    assert got[4, -1, "MIT"] == 1 and got[5, -2, "MIT"] == 1 and (6, 0, "MIT") not in got
    assert len([r for r in out if r.doc_id == 3]) == 2 * len([r for r in out if r.doc_id is None])
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_and_whole_licence_texts(spark):
    """A notice wrapped over lines is found however often it is repeated, and the twin agrees."""
    import duckdb

    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 300)
    wrapped = lambda t: "\n".join(" ".join(t.split()[k : k + 12]) for k in range(0, len(t.split()), 12))
    rows = [(n, "\n".join([wrapped(mit)] * n)) for n in (1, 2, 4, 5, 6, 8, 12, 50)]
    rows += [(100 + k, f"Copyright 2020 A. Nother\n\n{wrapped(t)}") for k, (_, t) in enumerate(L.TEMPLATES[-6:])]
    rows += [(200, " ".join(["Released under the MIT License."] * 200)), (201, "many other words " * 3000), (202, "\n" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.segment, r.license, round(r.dice, 9)) for r in L.license_scan(df).collect()}
    whole = {(i, name) for i, s, name, _ in got if s == -1}
    assert {(n, "MIT") for n in (1, 2, 4, 5, 6, 8, 12, 50)} <= whole
    assert {(100 + k, name) for k, (name, _) in enumerate(L.TEMPLATES[-6:])} <= {(i, name) for i, _, name, _ in got}
    assert (200, 0, "MIT") in {g[:3] for g in got} and not {g for g in got if g[0] in (201, 202)}
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents)
    assert {(i, s, n, round(d, 9)) for i, s, n, d in con.sql(f"SELECT doc_id, segment, license, dice FROM ({L.ORACLE})").fetchall()} == got
