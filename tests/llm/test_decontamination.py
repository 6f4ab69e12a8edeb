import random

from gradecube.llm import decontamination as D


def distance(a, b):
    row = [0] * (len(b) + 1)  # any start
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_best_match_is_exact():
    rnd = random.Random(4)
    for _ in range(300):
        a = [rnd.randint(1, 4) for _ in range(rnd.randint(1, 12))]
        b = [rnd.randint(1, 4) for _ in range(rnd.randint(0, 25))]
        d, s, e = D.best_match(a, b)
        assert d == distance(a, b) and 0 <= s <= e <= len(b)
        assert distance(a, b[s:e]) == d


def world(rnd):
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda n: rnd.choices(vocabulary, k=n)
    items = [(k, prose(rnd.choice([12, 20, 30, 45, 60, 150]))) for k in range(25)]
    docs, planted = [], set()
    for k in range(150):
        ws = prose(rnd.randint(5, 400))
        if k % 3 == 0:
            i, item = rnd.choice(items)
            p = list(item)
            for _ in range(rnd.choice([0, 0, len(p) // 20, len(p) // 10])):
                j = rnd.randrange(len(p))
                p[j : j + 1] = rnd.choice([[], ["new"], [p[j], "extra"]])
            at = rnd.randrange(len(ws))
            ws[at:at] = p
            planted.add((k, i))
        docs.append((k, " ".join(ws), "x"))
    return docs, [(i, ", ".join(ws).upper()) for i, ws in items], planted


def test_against_brute_force(spark):
    docs, items, planted = world(random.Random(6))
    want = {}
    for k, t, _ in docs:
        for i, text in items:
            a, b = D.tokens(text), D.tokens(t)
            if (d := distance(a, b)) <= D.edits_allowed(len(a), D.MOST_EDITS):
                want[k, i] = d
    assert planted <= set(want)
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in out.collect()}
    assert set(got) <= set(want) and all(got[x] == want[x] for x in got)
    assert len(got) >= 0.95 * len(want)


def test_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 1)
    docs = [(None, "before one two three four five six seven eight nine after"), (1, None), (2, ""), (3, "x " * 30000), (4, "short tale"), (4, "a short tale")]
    items = [(None, "One two, three four five six seven eight NINE!"), (7, "short tale"), (8, None), (9, ""), (7, "other words")]
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), str(r.item_id), r.distance) for r in out.collect()) == [("4", "7", 0), ("4", "7", 0), ("None", "None", 0)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_same_rows_however_dealt_and_recall_at_the_limit(spark):
    """600 texts with passages at exactly the allowed edits, in 1, 7 and 60 partitions."""
    rnd = random.Random(21)
    prose = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    items = [(k, prose(rnd.randint(10, 140))) for k in range(60)]
    docs, planted = [], set()
    for k in range(600):
        i, item = rnd.choice(items)
        p = list(item)
        for j in sorted(rnd.sample(range(len(p)), D.edits_allowed(len(p), D.MOST_EDITS)), reverse=True):
            p[j : j + 1] = rnd.choice([[], ["new"], [p[j], "extra"]])
        docs.append((k, " ".join(prose(rnd.randint(0, 80)) + p + prose(rnd.randint(0, 80)))))
        planted.add((k, i))
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    got = [sorted(map(tuple, D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), bench).collect())) for n in (1, 7, 60)]
    assert got[0] == got[1] == got[2]
    found = {r[:2] for r in got[0]}
    print("recall at 20 % edits", len(found & planted) / len(planted))
    assert len(found & planted) >= 0.95 * len(planted)
