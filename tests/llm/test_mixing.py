import random

import numpy as np
import pytest
from gradecube.llm import mixing as M
from pyspark.sql import functions as F


def corpus(n=240):
    rnd = random.Random(7)
    vocabulary = {"clean": "calm river stone meadow".split(), "junk": "%%% ### |||".split(), "toxic": "calm river vilezor grumpfen".split()}
    docs, labels = [], []
    for k in range(n):
        d = ["clean", "clean", "clean", "junk", "toxic", "clean"][k % 6]
        docs.append((k, " ".join(rnd.choices(vocabulary[d], k=rnd.randint(20, 60))), f"src{k % 3}", 0.5))
        if k % 2 or k % 5 == 0:
            labels.append((k, int(d != "junk"), int(d == "toxic")))
    return docs, labels


def solved(rows, targets):
    """The same least squares by plain projected gradient in numpy."""
    p = np.array([r.p for r in rows])
    t = np.array([r.n_tokens for r in rows], dtype=float)
    total, goal = t.sum(), np.array(targets) / sum(targets)
    weigh = np.linalg.inv((p * t[:, None]).T @ p / total + 1e-6 * np.eye(p.shape[1]))
    r = np.ones(len(t))
    for _ in range(5000):
        pull = p @ (weigh @ ((r * t) @ p / total - goal)) + M.PULL * (r - 1)
        r = np.maximum(0, r - pull / (1 + M.PULL))
    return r


@pytest.mark.parametrize("targets", [{"clean": 0.9, "junk": 0.06, "toxic": 0.04}, {"clean": 1, "junk": 1, "toxic": 2}])
def test_totals_and_rates(spark, targets):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, rate double")
    mix, rows = M.fit(d, M.domain_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), targets, ["doc_id"])
    got = sorted(rows.withColumn("rate", M.rate(mix.history, F.col("p"))[0]).collect(), key=lambda r: r.doc_id)
    want = solved(got, [targets[k] for k in mix.domains])
    assert all(r.rate >= 0 for r in got) and np.allclose([r.rate for r in got], want, atol=0.02)
    total = sum(r.n_tokens for r in got)
    for k, name in enumerate(mix.domains):
        assert sum(r.rate * r.n_tokens * r.p[k] for r in got) / total == pytest.approx(targets[name] / sum(targets.values()), abs=0.02)
    own = [mix.domains[int(np.argmax(r.p))] for r in got]
    assert sum(o == ["clean", "clean", "clean", "junk", "toxic", "clean"][k % 6] for k, o in enumerate(own)) >= 0.95 * len(own)


def test_odd_rows(spark):
    docs, labels = corpus(60)
    docs += [(None, "calm river", "x", 1.0), (900, None, None, None), (901, "", "x", 1.0), (902, "word " * 30000, "x", 1.0), (5, "calm", "x", 1.0)]
    labels += [(None, 1, 0), (6, None, None), (1, 0, 0), (1, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, rate double")
    domains = M.domain_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = M.mixing(d, domains).collect()
    assert len(out) == len(docs) and all(r.rate >= 0 and abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-5 for r in out)
    took = M.mixed(d, domains)
    assert took.columns == ["doc_id", "text", "source", "rate", "rate_", "copies"] and all(r.copies > 0 for r in took.collect())
    own = {(i, t, s, x) for i, t, s, x in docs}
    assert {(r.doc_id, r.text, r.source, r["rate"]) for r in took.collect()} <= own
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(abs(r.rate - 1) < 1e-4 for r in M.mixing(d, M.domain_of(none)).collect())
    assert M.mixing(d.limit(0), domains).count() == 0
