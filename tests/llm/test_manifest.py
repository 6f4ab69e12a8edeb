import hashlib
import random

import pytest
from gradecube.llm import manifest as M

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, tree int"


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The siblings of each leaf (side, digest or None) and the root, level by level."""
    at = list(range(len(nodes)))
    found = [[] for _ in nodes]
    while len(nodes) > 1:
        for k, p in enumerate(at):
            found[k].append((bool(p & 1), nodes[p ^ 1] if p ^ 1 < len(nodes) else None))
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [p >> 1 for p in at]
    return found, nodes[0]


@pytest.mark.parametrize("layer", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 16, 31, 32])
def test_traversal_gives_every_path(n, layer):
    leaves = [H(str(k)) for k in range(n)]
    want, root = tree(leaves)
    got = list(M.paths(leaves, (n - 1).bit_length(), layer))
    assert [p for p, _ in got] == want
    assert {r for _, r in got} == {root}


def test_traversal_holds_few_nodes(monkeypatch):
    # An existing and a desired subtree of each layer, and a stack: far fewer than the 2,048 nodes of the tree.
    leaves = [H(str(k)) for k in range(1024)]
    walk, most = M.paths(leaves, 10, 2), 0
    for _ in walk:
        held = walk.gi_frame.f_locals
        most = max(most, sum(map(len, held["existing"])) + sum(map(len, held["desired"])))
    assert most <= 2 * 5 * 6


def brute(rows, tampered=lambda d: False):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    tops, own = [], []
    for lang in langs:
        some = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])))
        found, root = tree([leaf(r[0], r[3], r[2], r[4], r[1]) for r in some])
        tops.append(root)
        own.append((some, found))
    above, root = tree(tops)
    out = []
    for k, (some, found) in enumerate(own):
        for r, path in zip(some, found):
            path = path + above[k]
            node = leaf(r[0], r[3], r[2], r[4] + 1 if tampered(r[0]) and r[4] is not None else r[4], r[1])
            for left, other in path:
                node = H(*([other] if left and other else []), node, *([other] if not left and other else []))
            out.append((r[0], leaf(r[0], r[3], r[2], r[4], r[1]), tops[k], root, H(*(x for _, x in path if x)), node, node == root))
    return sorted(out, key=str)


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    langs = ["en"] * 6 + ["de", "", None, "é", "z", "Z"]
    rows = [(k, rnd.choice(["text", "", None, "é" * 5, f"row {k}"]), rnd.choice(langs), rnd.choice(["s", None]), rnd.choice([None, k, 0]), "x", 1) for k in range(n)]
    return rows + [(None, "no id", "en", "s", 3, "x", 1), (None, "no id", "en", "s", 4, "x", 1), (2, "twice", "de", None, 1, "x", 1), (2, "twice", "de", None, 1, "x", 1), (7, "alone", "xx", None, 1, "x", 1)]


@pytest.mark.parametrize(("block", "parts"), [(1, 3), (2, 7), (12, 2)])
def test_storeys_against_one_tree(spark, monkeypatch, block, parts):
    import zlib

    rows = rows_of(200)
    random.Random(block).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    monkeypatch.setattr(M.merkle_manifest, "__defaults__", (*M.merkle_manifest.__defaults__[:-1], block))
    got = sorted((tuple(r) for r in M.op13_rows(df).collect()), key=str)
    assert got == brute(rows, lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 0)
    assert {r[6] for r in got} == {True, False}


def test_paths_prove_and_refuse(spark):
    rows = rows_of(20)
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.merkle_manifest(df, ["doc_id", "text"], block=2)
    checked = out.select(M.folded(out.leaf, out.path).alias("a"), M.folded(M.F.sha2(M.F.lit("other"), 256), out.path).alias("b"), "root").collect()
    assert all(r.a == r.root != r.b for r in checked)


def test_small_tables(spark):
    assert M.op13_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(1, "a" * 200_000, "en", "s", 1, "x", 1)]
    assert [tuple(r) for r in M.op13_rows(spark.createDataFrame(one, SCHEMA)).collect()] == brute(one)
