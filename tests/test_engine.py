"""Hand-checked cases, invariants, ingest and the interfaces that no table covers."""

import json
import math
import random

import pytest
from gradecube.functions import coercion, special, stats, text
from gradecube.operators import agreement, benchmark, elo, incremental, names, sampling, scores
from gradecube.plans import report, single
from gradecube.sources import benchmarks, json_files, responders
from gradecube.streaming import live
from gradecube import schemas
from pyspark.sql import functions as F

CUBE = "mode string, evaluator string, evaluator_ord int, question string, q_ord int, model string, model_ord int, score double"

CELLS = [
    ('{"score": 7}', 7, 7, 7, 7),
    ('{"score": 7.5}', 7.5, 7.5, 7.5, 7.5),
    ('{"score": "7"}', 7, 7, None, 7),
    ('{"score": "7.5"}', 7.5, None, None, 7.5),
    ('{"score": " 8 "}', 8, 8, None, 8),
    ('{"score": "-3"}', None, None, None, -3),
    ('{"score": "1e1"}', None, None, None, 10),
    ('{"score": "7..5"}', None, None, None, None),
    ('{"score": "8/10"}', None, None, None, None),
    ('{"score": "7d"}', None, None, None, None),
    ('{"score": true}', 1, 1, 1, 1),
    ('{"score": null}', None, None, None, None),
    ('{"reason": "x"}', None, None, None, None),
    ("null", None, None, None, None),
    ("7", None, None, 7, 7),
    ('"7"', None, None, None, 7),
]


def test_coercion_policies(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CELLS)], "k int, cell string")
    out = df.select("k", *[coercion.POLICIES[p](F.col("cell")).alias(p) for p in ("lenient", "elo", "strict", "cast")]).collect()
    for r in out:
        assert tuple(r)[1:] == CELLS[r.k][1:], CELLS[r.k]
    nan = spark.createDataFrame([('{"score": "nan"}',)], "cell string").select(coercion.cast(F.col("cell")), coercion.lenient(F.col("cell"))).first()
    assert math.isnan(nan[0]) and nan[1] is None


def cube(spark, cells):
    ms = sorted({c[1] for c in cells} | {c[3] for c in cells})
    qs = sorted({c[2] for c in cells})
    return spark.createDataFrame([(mode, e, ms.index(e), q, qs.index(q), m, ms.index(m), float(s)) for mode, e, q, m, s in cells], CUBE)


def made(seed=1, n=5, q=8):
    rnd = random.Random(seed)
    return [(mode, f"m{e}", f"q{k}", f"m{m}", rnd.randint(1, 10)) for mode in ("shuffle_blind", "shuffle_only", "blind_only") for e in range(n) for k in range(q) for m in range(n)]


def test_special_functions():
    assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.gamma_tail(2, 9.487729 / 2) == pytest.approx(0.05, abs=1e-6)
    assert special.gamma_tail(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    for df, t in ((1, 12.7062), (2, 4.3027), (5, 2.5706), (10, 2.2281), (30, 2.0423), (100, 1.9840)):
        assert special.t_critical(df) == pytest.approx(t, abs=1e-4)
    assert special.t_two_sided(1, 1) == pytest.approx(0.5) and special.t_two_sided(1, 2) == pytest.approx(1 - 1 / math.sqrt(3))


def test_statistics_of_small_samples(spark):
    one = spark.range(1)
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert tuple(one.select(low, high).first()) == (0.0, 0.0)
    for r, n in ((0.5, 3), (1.0, 10)):
        assert tuple(one.select(*stats.fisher(F.lit(r), F.lit(n))).first()) == (r, r)
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 5.0)], "x double, y double")
    assert flat.agg(stats.pearson("x", "y")).first()[0] == 0.0
    d = lambda *v: one.select(stats.cohens_d(*map(F.lit, v))).first()[0]
    assert d(5.0, 1.0, 1, 4.0, 1.0, 9) is None and d(5.0, 0.0, 4, 4.0, 0.0, 9) is None
    tail = one.select(stats.normal_tail(F.lit(1.959964))).first()[0]
    assert tail == pytest.approx(0.05, abs=1e-6)


def test_elo(spark):
    two = cube(spark, [("shuffle_blind", "j", "q", "a", 9), ("shuffle_blind", "j", "q", "b", 3)])
    assert sorted(r.elo for r in elo.ratings(elo.matches(two)).collect()) == [1484, 1516]
    c = cube(spark, made())
    m = elo.matches(c)
    rows = sorted(map(tuple, m.where("mode = 'blind_only'").select("ord", "a", "b", "outcome").collect()))
    want: dict = {}
    for _, a, b, o in rows:
        ra, rb = want.get(a, 1500.0), want.get(b, 1500.0)
        gain = 32 * (o - 1 / (1 + 10 ** ((rb - ra) / 400)))
        want[a], want[b] = ra + gain, rb - gain
    got = {r.model_ord: r.rating for r in elo.ratings(m).where("mode = 'blind_only'").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    assert sum(got.values()) / len(got) == pytest.approx(1500)
    listed = sorted(map(tuple, m.where("mode = 'blind_only'").select("evaluator_ord", "q_ord", "a", "b", "outcome").collect()))
    random.Random(42).shuffle(listed)
    drawn: dict = {}
    for _, _, a, b, o in listed:
        elo.step(drawn, a, b, o)
    got = {r.model_ord: r.rating for r in elo.ratings_in_drawn_order(c).where("mode = 'blind_only'").collect()}
    assert all(got[k] == pytest.approx(drawn[k], abs=1e-9) for k in drawn) and got.keys() == drawn.keys()
    t = elo.tallies(m)
    assert t.agg(F.sum(F.col("wins") + F.col("losses") + F.col("ties"))).first()[0] == 2 * m.count()


def test_score_invariants(spark):
    c = cube(spark, made(2))
    s = scores.peer_stats(c).collect()
    assert all(r.n + r.n_self == 40 for r in s)
    roster = c.select("model", "model_ord").distinct().unionByName(spark.createDataFrame([("none", 9)], "model string, model_ord int"))
    b = {r.model: r for r in scores.bias_analysis(c, roster).collect()}
    assert len(b) == 6 and b["none"].base == 0 == b["none"].name_bias
    assert scores.bias_analysis(c.where("mode <> 'blind_only'"), roster).count() == 0
    r = {(x.judge1, x.judge2): x.r for x in agreement.matrix(c).collect()}
    assert all(r[a, b] == r[b, a] for a, b in r) and all(r[a, a] == 1 for a, _ in r)
    assert agreement.pairs(c.where("q_ord = 0 AND model_ord < 2")).where("r <> 0").count() == 0  # two common cells


def taken(spark, available, target, even=False):
    rows = spark.createDataFrame([(name,) for name, n in available.items() for _ in range(n)], "s string")
    return {r.s: r.taken for r in sampling.quota_table(rows, "s", target, even).collect()}


def test_sampling(spark):
    assert taken(spark, {"easy": 2, "hard": 10, "medium": 10}, 15) == {"easy": 2, "hard": 7, "medium": 6}
    assert taken(spark, {"a": 1, "b": 1}, 9) == {"a": 1, "b": 1} and taken(spark, {"a": 1, "b": 9}, 7, True) == {"a": 1, "b": 3}
    rows = spark.createDataFrame([(f"s{k % 5}", k) for k in range(50)], "s string, id int")
    assert sampling.spread(rows, "s", "id", 3).select("s").distinct().count() == 3
    assert sampling.spread(rows, "s", "id", 12).count() == 12 and sampling.spread(rows.limit(0), "s", "id", 3).count() == 0


def test_blind_labels_beyond_z(spark):
    rows = spark.createDataFrame([("g", f"m{k:02d}") for k in range(30)], "g string, model string")
    labels = {r.label for r in sampling.blind_labels(rows, ["g"], "model").collect()}
    assert len(labels) == 30 and {"Response A", "Response Z", "Response AA", "Response AD"} <= labels


def test_names(spark):
    roster = spark.createDataFrame([("alpha-large", 0), ("alpha", 1), ("beta", 2)], "name string, ordinal int")
    said = spark.createDataFrame([("alpha",), (" [BETA] ",), ("alph",), ("",), ("gamma",)], "name string")
    assert {r.name: r.model for r in names.matched(said, roster).collect()} == {"alpha": "alpha", " [BETA] ": "beta", "alph": "alpha-large", "": "alpha-large", "gamma": None}


def test_text(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0]
    assert one(text.gold_answer, "a #### 3\nb #### 1,234.5") == 1234.5 and one(text.gold_answer, "none") is None
    assert one(text.model_answer, "so we have 12 apples") == 12 and one(text.model_answer, "") is None
    assert one(text.sanitized, "‘a’ “b” – c… d") == "'a' \"b\" - c... d"
    assert one(text.without_thoughts, "<think>a\nb</think>  c") == "c"
    assert one(text.error_class, "Rate limit 429") == "retry" and one(text.error_class, "Permission denied 500") == "final"
    got = lambda x: one(lambda c: text.extracted_json(c).cast("string"), x)
    assert json.loads(got('Here: ```json\n{"a": 1}\n```')) == {"a": 1} and got("no json") is None
    assert json.loads(got('So {"m": {"flags": []}} it is')) == []  # brackets come before braces
    assert one(text.duration, None) is None
    assert spark.range(1).select(text.duration(F.lit(12.34)), text.duration(F.lit(123.4))).first()[:] == ("12.3s", "2m 3.4s")


def test_unknown_answer_equals_unknown_gold(spark):
    rows = spark.createDataFrame([("?", "?"), ("A", "B")], "letter string, gold string")
    assert rows.where("letter = gold").count() == 1


def test_json_round(spark, tmp_path):
    cells = {"x": {"score": 7}, "y": {"score": "8"}, "z": 3}
    doc = {"revision": "r1", "evaluations_by_mode": {"shuffle_blind": {"x": {"q?": cells}}}}
    (tmp_path / "scores_r1.json").write_text(json.dumps(doc))
    df = json_files.load(spark, str(tmp_path), "scores", "r1", schemas.EVALUATIONS)
    assert {r.model: r.score for r in json_files.score_facts(df).collect()} == {"x": 7, "y": 8, "z": None}
    assert {r.model: r.score for r in json_files.score_facts(df, "strict").collect()} == {"x": 7, "y": None, "z": 3}
    assert json_files.latest_revision(spark, str(tmp_path), "scores") == "r1"
    assert json_files.load_optional(spark, str(tmp_path), "other", "r1", schemas.EVALUATIONS).count() == 0
    asked = {"questions_by_model": {"a": [{"question": "one"}, {"category": "c", "question": "two"}], "b": [{"category": "d", "question": "two"}, {"question": "Error: x"}]}}
    (tmp_path / "asked_r1.json").write_text(json.dumps(asked))
    q = json_files.questions(json_files.load(spark, str(tmp_path), "asked", "r1", schemas.QUESTIONS))
    assert {(r.question, r.source_model, r.category) for r in q.collect()} == {("one", "a", "general"), ("two", "b", "d")}
    facts = json_files.score_facts(df)
    json_files.save(facts, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).where("mode = 'shuffle_blind'").count() == 3


def test_registry_and_filters(spark):
    m = json_files.registry(spark, [{"provider": "p", "model_id": "a1", "name": "Alpha", "cost": (1, 2)}, {"provider": "p", "model_id": "b1", "name": "Beta"}])
    assert [r.name for r in json_files.active(m, include=["ALPHA", "beta"], exclude=["beta"]).collect()] == ["Alpha"]
    q = spark.createDataFrame([("current events",), ("logic",)], "category string")
    assert json_files.active_categories(q, include=["Event"]).count() == 1 == json_files.active_categories(q, exclude=["event"]).count()


def test_responders(spark):
    calls = []

    def flaky(model, prompt):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 rate limit")
        return "ok", 1, 1

    waits: list = []
    assert responders.retried(flaky, "m", "p", waits.append)[0] == "ok" and waits == [4, 8]
    with pytest.raises(RuntimeError):
        responders.retried(lambda m, p: (_ for _ in ()).throw(RuntimeError("401")), "m", "p", waits.append)
    prompts = spark.createDataFrame([("m", "one"), ("m", "two")], "model string, prompt string")
    out = responders.respond(prompts).collect()
    assert len(out) == 2 and all(r.error is None and r.text.startswith("The answer is") for r in out)


def test_resume_and_merge(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert [r.k for r in incremental.to_do(a, a.where("k = 1"), ["k"]).collect()] == [2]
    assert incremental.merged(a, a).count() == 4
    assert [r.v for r in benchmark.first_truth(a.unionByName(spark.createDataFrame([(3, "x")], "k int, v string")), "v", "k").where("v = 'x'").collect()] == ["x"]


def test_report(spark):
    c = cube(spark, made(3))
    qs = spark.createDataFrame([(f"q{k}", "cat", f"m{k % 5}") for k in range(8)], "question string, category string, source_model string")
    models = spark.createDataFrame([(f"m{k}", "P" if k % 2 else "Q") for k in range(5)], "name string, provider string")
    md = report.report(c, qs, models)
    assert md.count("## ") == 20 and "| m3" in md and "## Elo" in md and "████" in md and "## Method" in md
    own = spark.createDataFrame([("a", report.table(scores.peer_rankings(c)))], "file string, text string")
    first = report.table_rows(own).orderBy("row").collect()
    assert first[0].header[:2] == ["rank", "model"] and [r.cells[0] for r in first] == ["1", "2", "3", "4", "5"]
    text = "| a | b |\n|---|---|\n| 1 | 2 |\n\ntext\n| Model | Overall | x |\r\n|:--|--:|---|\n| m1 | 1 (8.72) |  |\n| m2 | 2 (7.5) | - |\nend\n| m3 | 9 |"
    many = spark.createDataFrame([("x", text), ("y", "no table"), ("z", None), ("", ""), ("last", "| Model | Overall |"), ("late", "t\n| Model | Overall |\n| m | (2) |\n")], "file string, text string")
    found = {(r.file, r.row): (r.header, r.cells) for r in report.table_rows(many, ("Model", "Overall")).collect()}
    head = ["Model", "Overall", "x"]
    assert found == {("x", 0): (head, ["m1", "1 (8.72)"]), ("x", 1): (head, ["m2", "2 (7.5)", "-"]), ("late", 0): (head[:2], ["m", "(2)"])}
    got = {(r.name, r.column): (r.cell, r.score) for r in report.table_cells(report.table_rows(many, ("Model", "Overall"), "(")).collect()}
    assert got == {("m1", "Overall"): ("1 (8.72)", 8.72), ("m2", "Overall"): ("2 (7.5)", 7.5), ("m2", "x"): ("-", None), ("m", "Overall"): ("(2)", 2.0)}
    cells = spark.createDataFrame([("1 (8.72)",), ("-",), (None,)], "c string")
    assert [r[0] for r in cells.select(report.ranked_score(cells.c)).collect()] == [8.72, None, None]
    acc = spark.createDataFrame([(f"m{k}", k, 5 + k, 10, 50.0 + 10 * k, 5.0 + k) for k in range(5)], "model string, model_ord int, correct long, total long, accuracy double, mean double")
    md = report.validation_report(c, acc, "Test")
    assert md.startswith("# Test") and md.count("## ") == 10 and "over_rated" in md


def test_quotas_fill_like_water(spark):
    rnd = random.Random(3)
    for _ in range(25):
        available = {f"s{k}": rnd.randint(1, 9) for k in range(rnd.randint(0, 6))}
        target = rnd.randint(0, 40)
        got = taken(spark, available, target)
        assert sum(got.values()) == min(target, sum(available.values())) and all(got[s] <= n for s, n in available.items())
        open_ = [q for s, q in got.items() if q < available[s]]
        assert not open_ or max(got.values()) <= min(open_) + 1  # no stratum has two more than one that could take more


def test_stream(spark, tmp_path):
    c = cube(spark, made(4))
    c.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).parquet(str(tmp_path / "in"))
    q = live.start(stream, str(tmp_path / "cp"), "totals")
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.select("mode", "model", "total", "n").collect()))
    assert key(spark.table("totals")) == key(live.peer_totals(c))


def test_single_question_results(spark):
    cells = [("shuffle_blind", "a", "q", "b", 8), ("shuffle_blind", "b", "q", "a", 6), ("shuffle_blind", "a", "q", "a", 9), ("shuffle_only", "a", "q", "b", 7)]
    c = cube(spark, cells)
    got = [tuple(r) for r in single.question_results(c, ["a", "b", "z"]).orderBy("rank").collect()]
    assert got == [("q", 1, "b", 8.0, None, None), ("q", 2, "a", 6.0, 9.0, 3.0), ("q", 3, "z", None, None, None)]
    got = [tuple(r) for r in single.question_name_bias(c, ["a", "b"]).orderBy("rank").collect()]
    assert got == [("q", 1, "b", 7.0, 1.0), ("q", 2, "a", None, None)]


def test_benchmark_readers(spark):
    m = spark.createDataFrame([("q", "Step one\nso 3\n#### 1,003"), ("n", None)], "question string, answer string")
    got = {r.question: r for r in benchmarks.math_problems(m).collect()}
    assert got["q"].gold_num == 1003 and got["q"].difficulty and got["n"].gold_num is None
    s = spark.createDataFrame([("q", "law", ["x"], 0), ("r", None, ["y"], 0)], "question string, subject string, choices array<string>, answer int")
    assert [r.subject for r in benchmarks.subject_questions(s).orderBy("question").collect()] == ["law", "unknown"]
    assert benchmarks.subject_questions(s, ["law"]).count() == 1
    t = spark.createDataFrame([("q", ["x", "y"], [0, 1]), ("r", ["x"], [0])], "question string, choices array<string>, labels array<int>")
    g = spark.createDataFrame([("q", "nowhere")], "question string, category string")
    assert [(r.question, r.category, r.correct_index) for r in benchmarks.truthful_questions(t, g).collect()] == [("q", "factual knowledge", 1)]


def test_health_and_search(spark):
    def search(model, prompt):
        if prompt == "bad":
            raise ValueError("invalid key")
        return "x" * 300 + "\nshort", 1, 1

    ms = spark.createDataFrame([("a", "anthropic", "m"), ("b", "xai", "n")], "name string, provider string, model_id string")
    assert [(r.model, r.healthy, r.reasoning) for r in responders.health(ms).orderBy("model").collect()] == [("a", True, "extended thinking: OFF"), ("b", True, "standard")]
    qs = spark.createDataFrame([("bad",), ("good",)], "question string")
    got = {r.question: r for r in responders.searched(qs, lambda: search).collect()}
    assert got["good"].success and got["good"].grounding == "x" * 250 + "\nshort"
    assert not got["bad"].success and got["bad"].grounding == ""


def test_names_by_pieces(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abAB-1", k=rnd.randint(1, 7)))
    roster = list(dict.fromkeys(word() for _ in range(40)))
    given = [word() for _ in range(60)] + [f"[{roster[3]}]", f" {roster[5].upper()} ", "", "[ ]", "zz", None]

    def plain(name):
        if name is None:
            return None
        clean = name.strip("[] \t\n")
        return clean if clean in roster else next((r for r in roster if clean.lower() in r.lower()), None)

    r = spark.createDataFrame([(n, k) for k, n in enumerate(roster)], "name string, ordinal int")
    df = names.matched(spark.createDataFrame([(n,) for n in given + given[:5]], "name string"), r)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert {x.name: x.model for x in df.collect()} == {n: plain(n) for n in given}
    assert names.matched(spark.createDataFrame([(n,) for n in given], "name string"), r.limit(0)).where("model IS NOT NULL").count() == 0


def test_cells_of_names_as_written(spark):
    from gradecube.operators import elo

    r = spark.createDataFrame([("gpt-5", 0), ("claude", 1), ("gem", 2)], "name string, ordinal int")
    raw = [("s", "GPT", 0, 7, m, k, c) for k, (m, c) in enumerate([("[claude]", '{"score": 4}'), ("gpt-5", '{"score": 9}'), ("clau", '{"score": "6"}'), ("claude", '{"score": "6.5"}'), ("nobody", '{"score": 1}'), ("gem", '{"score": 8}')])]
    raw += [("s", "guest", 1, 7, "gpt-5", 0, '{"score": 3}'), ("s", "guest", 1, 7, "gem", 1, '{"score": 3}')]
    df = spark.createDataFrame(raw, "mode string, evaluator string, evaluator_ord int, q_ord int, model string, position int, cell string")
    got = sorted((x.evaluator, x.model, x.score) for x in elo.resolved(df, r).collect())
    assert got == [("gpt-5", "claude", 6.0), ("gpt-5", "gem", 8.0), ("gpt-5", "gpt-5", 9.0), ("guest", "gem", 3.0), ("guest", "gpt-5", 3.0)]
    met = sorted((x.evaluator_ord, x.a, x.b, x.outcome) for x in elo.matches(elo.resolved(df, r)).collect())
    assert met == [(0, 1, 2, 0.0), (1, 0, 2, 0.5)]


def test_mixed_question_files(spark, tmp_path):
    files = {
        "a.json": {"revision": "r", "questions_by_model": {"z": [{"question": "q1"}, "plain", "Error: none", {"category": "c", "question": "Error is what?"}, 7, {"other": 1}, None], "b": {"questions": [{"category": None, "question": "q2"}]}, "c": "nothing", "d": []}},
        "b.json": {"revision": "s", "questions_by_model": {"m": ["x"]}},
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body, indent=1))
    (tmp_path / "c.json").write_text("no JSON")
    got = sorted((r.file, r.revision, r.i, r.source_model, r.j, r.category, r.question) for r in json_files.mixed_questions(json_files.whole(spark, str(tmp_path))).collect())
    assert got == [("a.json", "r", 0, "z", 0, "general", "q1"), ("a.json", "r", 0, "z", 1, "general", "plain"), ("a.json", "r", 0, "z", 3, "c", "Error is what?"), ("a.json", "r", 1, "b", 0, "general", "q2"), ("b.json", "s", 0, "m", 0, "general", "x")]


def test_document_is_taken_while_current(spark, tmp_path):
    from gradecube.plans import analysis

    rows = [(f"m{k}", k, 9.0 - k, 10 - k, 8.5 - k * 0.7, 80.0 - 7 * k, 8 - k, 10, k + 1, float(k + 1)) for k in range(5)]
    c = spark.createDataFrame(rows, "model string, model_ord int, peer double, n long, truth double, accuracy double, correct long, total long, peer_rank long, truth_rank double").withColumn("rank_diff", F.col("peer_rank") - F.col("truth_rank"))
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text("{}")
    made = []

    def make(name):
        made.append(name)
        return analysis.document(c, name)

    get = lambda name: analysis.kept(spark, folder, [str(source), str(tmp_path / "gone")], lambda: make(name), "Test").first()
    assert get("one").revision == "one" and get("two").revision == "one" and made == ["one"]
    later = __import__("time").time() + 60
    __import__("os").utime(source / "a.json", (later, later))
    doc = get("three")
    assert doc.revision == "three" and made == ["one", "three"]
    assert doc.n_models == 5 and doc.correlation.pearson == 1.0 and doc.agreement.exact == 5 and doc.comparison[0].model == "m0"
    assert doc.over_rated.model == "m0" and doc.under_rated.model == "m4"
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/report", wholetext=True).collect())
    assert text.startswith("# Test") and "Pearson r 1.0000" in text and text.count("m3 ") == 2 and "strongly correlates" in text
    assert analysis.document(c.limit(0), "none").count() == 0


def test_evaluation_files_of_either_form(spark, tmp_path):
    cells = {"e1": {"q": {"m1": {"score": 7}, "m2": {"score": "8"}}}}
    bodies = {"old": {"revision": "a", "evaluations": cells}, "new": {"revision": "b", "evaluations_by_mode": {"shuffle_only": cells, "shuffle_blind": cells}}}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("[")
    files = json_files.whole(spark, str(tmp_path))
    facts = json_files.score_facts(json_files.evaluation_files(files)).collect()
    assert sorted((r.revision, r.mode, r.model, r.score) for r in facts) == [("a", "shuffle_blind", "m1", 7.0), ("a", "shuffle_blind", "m2", 8.0)] + [("b", m, x, s) for m in ("shuffle_blind", "shuffle_only") for x, s in (("m1", 7.0), ("m2", 8.0))]
    assert json_files.has_modes(files) and not json_files.has_modes(files.where("file = 'old.json'")) and not json_files.has_modes(files.limit(0))


def test_rankings_of_a_session_follow_corrections(spark, tmp_path):
    schema = "mode string, evaluator string, question string, model string, score double, version long"
    rnd = random.Random(2)
    names = ["a", "b", "c"]
    cell = lambda v, s=None: (rnd.choice(["shuffle_blind", "shuffle_only"]), rnd.choice(names), rnd.choice(["q1", "q2"]), rnd.choice(names), s if s is not None else rnd.choice([None, *map(float, range(1, 11))]), v)
    batches = [[cell(v * 100 + k) for k in range(25)] for v in range(3)]
    batches[2] += [(*batches[0][0][:4], 1.0, -1), (*batches[1][1][:4], 10.0, 999), (*batches[1][2][:4], None, 998)]
    source = tmp_path / "in"
    source.mkdir()
    out = {}

    def sink(df, _):
        for r in df.collect():
            out[r.question, r.mode, r.rank] = (r.model, r.peer, r.self)

    stream = spark.readStream.schema(schema).parquet(str(source))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = live.session_rankings(stream, names).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen = spark.createDataFrame([r for b in batches[: k + 1] for r in b], schema)
        cube_ = live.latest(seen)
        for mode in ("shuffle_blind", "shuffle_only"):
            want = {(r.question, mode, r.rank): (r.model, r.peer, r.self) for r in single.question_scores(cube_, names, mode).collect()}
            got = {key: v for key, v in out.items() if key[1] == mode}
            assert got.keys() >= want.keys()
            assert {key: tuple(round(x, 9) if isinstance(x, float) else x for x in got[key]) for key in want} == {key: tuple(round(x, 9) if isinstance(x, float) else x for x in v) for key, v in want.items()}


def test_small_filters(spark):
    from gradecube.operators import catalog, questions

    rows = spark.createDataFrame([("easy", "a"), ("hard", "b"), (None, "c")], "difficulty string, name string")
    names_of = lambda df: sorted(r.name for r in df.collect())
    assert names_of(catalog.of_difficulty(rows, ["hard", "odd"])) == ["b"] and names_of(catalog.of_difficulty(rows, ["odd"])) == ["a", "b", "c"]
    out = catalog.toggled(rows.limit(0), rows, "b")
    assert names_of(out) == ["b"] and names_of(catalog.without(rows, out)) == ["a", "c"]
    assert names_of(catalog.toggled(out, rows, "b")) == [] and names_of(catalog.toggled(out, rows, "zz")) == ["b"]
    assert [r[0] for r in rows.orderBy("name").select(catalog.colour(F.col("name"), {"a": "#123456"})).collect()] == ["#123456", "#666666", "#666666"]
    assert rows.select(catalog.colour(F.col("name"), {})).distinct().count() == 1
    assert names_of(scores.of_roster(rows, spark.createDataFrame([("b",), ("b",)], "model string"), "name")) == ["b"]
    q = spark.createDataFrame([("m", "c", "x" * 80), ("m", "c", "short")], "source_model string, category string, question string")
    assert sorted(len(r.id) for r in questions.autopsy_rows(q).collect()) == [5, 50]


def test_session_of_one_question(spark):
    sessions = spark.createDataFrame([("a", {"a": '{"score": 9}', "b": '{"score": "7"}'}), ("b", {"a": "{}", "b": '{"score": 3}'}), ("c", {})], "evaluator string, scores map<string,string>")
    facts = single.session_facts(sessions, ["a", "b", "c"])
    got = sorted((r.evaluator, r.model, r.question, r.score) for r in facts.collect())
    assert got == [("a", "a", "q1", 9.0), ("a", "b", "q1", 7.0), ("b", "a", "q1", None), ("b", "b", "q1", 3.0)]
    ranks = {r.model: (r.rank, r.peer, r.self) for r in single.question_scores(facts, ["a", "b", "c"]).collect()}
    assert ranks == {"b": (1, 7.0, 3.0), "a": (2, None, 9.0), "c": (3, None, None)}


def test_judge_report_and_alignment(spark):
    from gradecube import fixtures as fx

    c = cube(spark, made(3))
    models = spark.createDataFrame([(f"m{k}", "P", f"id{k}", k, 1.0, 2.0) for k in range(5)], "name string, provider string, model_id string, ordinal int, in_per_m double, out_per_m double")
    answers = spark.createDataFrame([(k, f"m{k}", k, 10, 20, "t" if k else " ") for k in range(5)], "q_ord int, model string, model_ord int, in_tok long, out_tok long, text string")

    class Writer(fx.Canned):
        def ask(self, model_id, prompt):
            if model_id == "id4":
                raise ValueError("invalid request")
            assert "my report" in prompt
            return f"Insight of {model_id}.", 1, 1

    md = report.judge_report(answers, models, c, "my report", "m1", Writer)
    assert md.startswith("# Analysis by m1\n\nInsight of id1.") and md.count("## ") == 2
    assert "invalid request" in report.judge_report(answers, models, c, "my report", "m4", Writer)
    assert "no such model" in report.judge_report(answers, models, c, "my report", "zz", Writer)
    df = spark.createDataFrame([("a", 1, "x")], "l string, r int, c string")
    assert report.table(df, right=("r",), centre=("c",)).split("\n")[1:] == ["|-----|----:|:---:|".replace("|-----|", "|-----|"), "| a   |   1 |  x  |"]
    qs = spark.createDataFrame([(f"q{k}", "cat", f"m{k % 5}") for k in range(8)], "question string, category string, source_model string")
    full = report.report(c, qs, models, answers, spark.createDataFrame([("m1", 0.0), ("m2", 3.0)], "model string, seconds double"))
    assert "## Refusals" in full and "## Failures" in full and "| m0" in full


def test_scores_as_they_are(spark):
    df = spark.createDataFrame([('{"score": 7}',), ("8.5",), ('{"reason": "x"}',), (None,), ('{"score": true}',)], "c string")
    assert [r[0] for r in df.select(coercion.none(F.col("c"))).collect()] == [7.0, 8.5, None, None, 1.0]
    with pytest.raises(Exception, match="a score is a text: 7"):
        spark.createDataFrame([('{"score": "7"}',)], "c string").select(coercion.none(F.col("c"))).collect()
