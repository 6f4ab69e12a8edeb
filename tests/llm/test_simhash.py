import itertools
import random

import numpy as np
from gradecube.llm import simhash
from gradecube.llm.components import components

SCHEMA = "doc_id long, text string, fp string"


def brute(rows, within=2):
    import xxhash

    fps = {}
    for i, t, *_ in rows:
        ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()]
        sh = [b" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([b" ".join(ws)] if ws else [])
        hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= within:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def result(spark, rows):
    out = simhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.fingerprint, r.component_id) for r in out}


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["É", "naïve", " x"]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for k in range(60)]
    base = rnd.choices(words, k=400)
    for k in range(60, 110):
        copy = list(base)
        copy[rnd.randrange(400)] = "edited"
        rows.append((k, "\t\n".join(copy).upper() if k % 2 else " ".join(copy)))
    rows += [(110, None), (111, ""), (112, "one"), (113, "one two"), (114, "ONE\x0btwo"), (115, " ".join(base))]
    assert result(spark, rows) == brute(rows)


def test_hot_bucket_links_without_pairs(spark, monkeypatch):
    rnd = random.Random(1)
    base = rnd.getrandbits(63)
    fps = [(base ^ sum(1 << b for b in rnd.sample(range(63), rnd.randint(0, 3))),) for _ in range(120)] + [(rnd.getrandbits(63),) for _ in range(50)]
    df = spark.createDataFrame(fps, "fp long").distinct()
    want = None
    for limit in (2, 1000):
        monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
        got = {(r.node, r.root) for r in components(simhash.links(df, 2)).collect()}
        assert want is None or got == want
        want = got
    assert want


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0


def test_thresholds_sum_and_cost():
    cost, ts = simhash.allotted([[0, 5, 9, 20], [0, 1, 30, 40], [0, 2, 3, 50]], 0)
    assert sum(ts) == 0 and cost == 4 and ts == [-1, 0, 1]
    groups = simhash.correlated_groups(10, np.eye(64) * 5, simhash.even_sizes(3))
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert len(simhash.flips(21, 1)) == 22 and len(simhash.flips(64, 1)) == 65


def test_one_of_each(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_LIMIT", 4)
    rnd = random.Random(9)
    prose = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    rows, k = [], 0
    alone = []
    for _ in range(40):
        alone.append(k)
        rows.append((k, " ".join(prose(200)), "a"))
        k += 1
    firsts = []
    for _ in range(4):
        base = prose(300)
        firsts.append(k)
        for _ in range(15):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(300)] = "edited"
            rows.append((k, " ".join(copy), "b"))
            k += 1
    rows += [(k, None, "c"), (k + 1, "", "c"), (None, "", "c"), (0, rows[0][1], "a"), (None, rows[1][1], "a")]
    got = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, digest string")).collect())
    assert got == [*alone, *firsts, k]
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_holds_whatever_the_number_of_texts():
    rng = np.random.default_rng(1)
    share = np.arccos(2 * 0.8 / 1.8) / np.pi
    for n in (10_000, 200_000, 1_000_000, 10_000_000):
        width, count = simhash.wide_width(n), simhash.partition_count(n, 0.8)
        places = simhash.drawn_places(count, width)
        differ = rng.random((2000, simhash.WORDS * 64)) < share
        met = np.zeros(2000, dtype=bool)
        for g in places:
            met |= ~differ[:, [j * 64 + b for j, b in g]].any(axis=1)
        assert len(places) == count and met.mean() >= simhash.RECALL - 0.015, (n, width, count, met.mean())


def wide(rnd, low, near=None):
    """A wide fingerprint with the given low byte, at random or six bits from another."""
    words = [rnd.getrandbits(64) for _ in range(simhash.WORDS)] if near is None else [w ^ (1 << 40) if j < 6 else w for j, w in enumerate(near)]
    return [words[0] >> 8 << 8 | low, *words[1:]]


def linked(spark, fps):
    rows = [(k, [w - (1 << 64) if w >> 63 else w for w in x]) for k, x in enumerate(fps)]
    return {(r.node, r.root) for r in components(simhash.similar_links(spark.createDataFrame(rows, "node long, fp array<long>"), 0.8)).collect()}


def test_all_small_families_of_a_large_bucket_are_found(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_LIMIT", 4)
    monkeypatch.setattr(simhash, "wide_plan", lambda *_: [([(0, b) for b in range(8)], 0)])
    rnd = random.Random(3)
    firsts = [wide(rnd, 7) for _ in range(30)]
    got = linked(spark, firsts + [wide(rnd, 7, x) for x in firsts])
    assert got == {(k + d, k) for k in range(30) for d in (0, 30)}


def test_probes_of_radius_one_reach_single_texts_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_LIMIT", 4)
    monkeypatch.setattr(simhash, "wide_plan", lambda *_: [([(0, b) for b in range(8)], 1)])
    rnd = random.Random(4)
    single, crowd = wide(rnd, 0b11), [wide(rnd, 0b11110000) for _ in range(20)]
    fps = [single, wide(rnd, 0b10, single), *crowd, *(wide(rnd, 0b11110000 ^ 1 << j, x) for j, x in enumerate(crowd[:3])), wide(rnd, 0b11110011, crowd[3])]
    assert linked(spark, fps) == {(0, 0), (1, 0), *((k, k) for k in (2, 3, 4, 5)), *((k + 20, k) for k in (2, 3, 4, 5))}


def test_outer_joins_take_a_row_a_text_however_large_a_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "wide_plan", lambda *_: [([(j, b) for b in range(8)], 0) for j in range(12)])
    rnd = random.Random(9)
    first, other = ([rnd.getrandbits(64) for _ in range(simhash.WORDS)] for _ in range(2))
    other[:12] = first[:12]
    far = lambda x: [w ^ sum(1 << b for b in rnd.sample(range(64), 8)) if j >= 12 else w for j, w in enumerate(x)]
    fps = [x for _ in range(60) for x in (far(first), far(other))]
    kind, taken = type(spark.range(1)), []
    join = kind.join

    def counted(self, other, on=None, how=None):
        if how == "left":
            taken.append(self.count())
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", counted)
    assert linked(spark, fps) == {(k, k % 2) for k in range(120)}
    assert taken and max(taken) <= 120  # each text is in 12 buckets


def test_rows_of_buckets_are_made_once_and_grow_with_the_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "wide_plan", lambda *_: [([(j, b) for b in range(8)], 0) for j in range(4)])
    monkeypatch.setattr(simhash, "TASK_LIMIT", 16)
    made = {}

    def counting(name, kind):
        make, n = getattr(simhash, name), spark.sparkContext.accumulator(0)
        made[name] = n

        def count(batches):
            for b in batches:
                n.add(b.num_rows)
                yield b

        monkeypatch.setattr(simhash, name, lambda *args: make(*args).select("key", "part", "node", "root").mapInArrow(count, kind))

    counting("rooted", "key long, part int, node long, root long")
    counting("subdivided", "key long, part int, node long, root long")
    monkeypatch.setattr(simhash, "LEVELS", 1)
    ways = next(k for k in itertools.count(1) if simhash.found(simhash.SPLIT_BITS, k, 0.8) >= simhash.SPLIT_RECALL)
    rnd = random.Random(9)
    for size in (20, 40):
        first, other = ([rnd.getrandbits(64) for _ in range(simhash.WORDS)] for _ in range(2))
        other[:4] = first[:4]
        before = {k: n.value for k, n in made.items()}
        assert linked(spark, [x for _ in range(size // 2) for x in (first, other)]) == {(k, k % 2) for k in range(size)}
        rows = 4 * (size - 1)  # all but the lead, each in 4 buckets
        assert {k: n.value - before[k] for k, n in made.items()} == {"rooted": rows, "subdivided": ways * rows}


def test_exact_similarity_decides(spark):
    rnd = random.Random(6)
    rows, want = [], set()
    for k in range(0, 400, 2):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(204)]
        n = 22 if k % 4 else 23  # of 200 shingles each, 178 are shared (J = 178/222 = 0.802) or 177 (0.794)
        rows += [(k, " ".join(words)), (k + 1, " ".join(words[:-n] + [f"x{k}y{j}" for j in range(n)]))]
        want |= {k} if k % 4 else {k, k + 1}
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not want - got and len(got - want) <= 15  # of 100 pairs at the limit some five are no candidates


def jaccard_links(texts):
    """All pairs of texts alike by 0.8 or more, and their similarity."""
    sets = [simhash.shingle_set(t, 5) for t in texts]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    both = {}
    for ks in holders.values():
        for a, b in itertools.combinations(ks, 2):
            both[a, b] = both.get((a, b), 0) + 1
    return {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in both.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.8}


def test_recall_against_brute_force_with_a_hot_group(spark, monkeypatch):
    rnd = random.Random(8)
    prose = lambda n: [f"w{rnd.randrange(20000)}" for _ in range(n)]
    texts, base = [], prose(160)
    for _ in range(350):  # a hot group around one text, edited so much that most of its pairs are under 0.8
        copy = list(base)
        for _ in range(rnd.randint(0, 12)):
            copy[rnd.randrange(160)] = f"x{rnd.randrange(10**6)}"
        texts.append(copy)
    for _ in range(1500):
        one = prose(rnd.randint(60, 300))
        two = list(one)
        for _ in range(rnd.randint(0, max(1, len(one) // 40))):
            two[rnd.randrange(len(one))] = f"y{rnd.randrange(10**6)}"
        texts += [one, two]
    texts += [prose(80) for _ in range(1500)]
    texts = sorted({" ".join(t) for t in texts})
    pairs = jaccard_links(texts)
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    fps = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(fps, "doc_id long, text string")
    wide = simhash.stored(simhash.wide_fingerprints(df, 5).select(simhash.F.col("doc_id").alias("node"), "fp"))
    known = df.withColumnRenamed("doc_id", "node")
    for limit in (2000, 40):
        monkeypatch.setattr(simhash, "TASK_LIMIT", limit)
        monkeypatch.setattr(simhash, "SPLIT_BITS", 3)
        monkeypatch.setattr(simhash, "MANY", 1)  # so that buckets come again
        edges = simhash.similar_links(wide, 0.8, lambda nodes: known.join(nodes, "node", "left_semi"))
        got = {r.node: r.root for r in components(edges).collect()}
        met = [p for p in pairs if got.get(p[0], -1) == got.get(p[1], -2)]
        assert len(met) >= 0.97 * len(pairs), (limit, len(met), len(pairs))
        low = [p for p, j in pairs.items() if j < 0.83]
        assert len(low) > 100 and sum(got.get(a, -1) == got.get(b, -2) for a, b in low) >= 0.9 * len(low)
        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        assert all(find(k) == find(r) for k, r in got.items())
