import hashlib
import random

import numpy as np
import pytest
from gradecube.llm import suffix_dedup as S


def brute(texts, size):
    datas = [(t or "").encode() for t in texts]
    seen = {}
    for d in datas:
        for i in range(len(d) - size + 1):
            seen[d[i : i + size]] = seen.get(d[i : i + size], 0) + 1
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), bytes([0, *gone]).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return out


def make(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = [prose(60) for _ in range(3)]
    texts = [prose(rnd.randint(0, 150)) for _ in range(25)]
    for k in range(15):
        p = rnd.choice(passage)
        i = rnd.randrange(len(p) // 2)
        texts.append(prose(rnd.randint(0, 30)) + p[i : i + rnd.randint(150, 330)] + prose(rnd.randint(0, 30)))
    base = prose(200)
    for k in range(8):
        j = rnd.randrange(len(base))
        texts.append(base[:j] + "#" + base[j + 1 :])
    return texts + [base, base, None, "", "a" * 199, "a" * 200, "b" * 500, "ab" * 300, "é" * 150, "short", "short"]


@pytest.mark.parametrize(("seed", "limit"), [(1, 2000), (2, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(S, "GROUP_LIMIT", limit)
    texts = make(seed)
    rows = [(k, t, b"x") for k, t in enumerate(texts)]
    out = {r.doc_id: r for r in S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, key binary")).collect()}
    want = brute(texts, 200)
    got = [(out[k].n_bytes, sum(x.end - x.start for x in out[k].removed), len(out[k].removed), out[k].kept_sha256) for k in range(len(texts))]
    assert got == want


def test_chunks_join(monkeypatch):
    data = make(3)[0].encode() * 40
    want = [x.tolist() for x in S.minimizers(data)]
    monkeypatch.setattr(S, "CHUNK", 50)
    assert [x.tolist() for x in S.minimizers(data)] == want


def test_empty_and_null_ids(spark):
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = S.suffix_dedup(spark.createDataFrame([(None, "x" * 300), (1, "y" * 100), (1, "y" * 100)], "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, len(r.removed)) for r in out) == [(100, 0), (100, 0), (300, 1)]


def test_radix_sort_is_exact():
    rnd = random.Random(3)
    for size in (1, 3, 8, 11, 16, 20):
        for _ in range(20):
            x = np.frombuffer(bytes(rnd.choices(b"ab" if size > 3 else b"abcdefgh", k=rnd.randint(size, 400))), dtype=np.uint8)
            at = np.array(sorted(rnd.sample(range(len(x) - size + 1), rnd.randint(0, len(x) - size + 1))), dtype=np.int64)
            strings = [x[i : i + size].tobytes() for i in at]
            assert sorted(S.equal_suffixes(x, at, size)) == [i for i, t in zip(at.tolist(), strings) if strings.count(t) > 1]
