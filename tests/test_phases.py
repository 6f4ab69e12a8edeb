"""Phases that ask models: limits of providers, commits and resuming."""

import json
import os
import sys
import time
import uuid

import pytest
from gradecube import fixtures as fx
from gradecube import queries
from gradecube.plans import phases
from gradecube.sources import providers
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests

MODELS = [("a1", "alpha", 0, 1.0, 2.0), ("a2", "alpha", 1, 1.0, 2.0), ("b1", "beta", 2, 0.5, 0.5)]


@pytest.fixture
def models(spark):
    return spark.createDataFrame([(n, p, n, o, i, u) for n, p, o, i, u in MODELS], "name string, provider string, model_id string, ordinal int, in_per_m double, out_per_m double")


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(str(k), f"What is {k}?") for k in range(40)], "question_id string, question string")


class Timed:
    """Writes down when each call began and ended, and when its client was closed."""

    def __init__(self, folder, provider):
        self.folder, self.provider, self.id = folder, provider, uuid.uuid4().hex

    def note(self, what):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            json.dump([self.provider, self.id, *what], f)

    def ask(self, model_id, prompt):
        began = time.time()
        time.sleep(0.03)
        self.note([began, time.time()])
        return f"reply of {model_id}", 1, 2

    def close(self):
        self.note(["closed"])
        raise RuntimeError("a client that cannot be closed")


def most_at_once(spans):
    edges = sorted([(b, 1) for b, _ in spans] + [(e, -1) for _, e in spans])
    now = most = 0
    for _, d in edges:
        now += d
        most = max(most, now)
    return most


def test_no_provider_has_more_calls_than_its_limit(spark, tmp_path):
    limits = {"alpha": 3, "beta": 6, "gamma": 1}
    rows = [(p, f"{p}{k % 3}", f"prompt {k}") for p in limits for k in range(60)]
    folder = str(tmp_path)
    df = spark.createDataFrame(rows, "provider string, model_id string, prompt string").repartition(9)
    out = providers.asked(df, list(limits), lambda p: Timed(folder, p), limits, pool=2).collect()
    assert len(out) == 180 and all(r.text == f"reply of {r.model_id}" and r.error is None for r in out)
    notes = [json.load(open(os.path.join(folder, f))) for f in os.listdir(folder)]
    for p, limit in limits.items():
        most = most_at_once([x[2:] for x in notes if x[0] == p and len(x) == 4])
        assert 1 <= most <= limit
    assert most_at_once([x[2:] for x in notes if x[0] == "beta" and len(x) == 4]) > 1
    made = {x[1] for x in notes if len(x) == 4}
    assert made == {x[1] for x in notes if len(x) == 3}  # every client that was asked was closed
    assert len(made) <= sum(-(-n // 2) for n in limits.values())  # one a task


def test_slots_add_up_to_limits():
    for limit in range(1, 12):
        dealt = providers.slots(["x"], {"x": limit}, 4)
        assert sum(n for _, n in dealt) == limit and max(n for _, n in dealt) <= 4
    assert providers.slots(["other"]) == [("other", 3), ("other", 2)]


def test_odd_requests(spark):
    df = spark.createDataFrame([("alpha", "m", "p", 1), (None, "m", "p", 2), ("new", "m", "p", 3)], "provider string, model_id string, prompt string, extra int")
    out = {r.extra: r for r in providers.asked(df, ["alpha"], fx.Canned).collect()}
    assert out[1].error == "invalid request" and out[2].error == "unknown provider: None" and out[3].text is None
    assert providers.asked(df.limit(0), ["alpha"], fx.Canned).count() == 0
    assert providers.asked(df, [], fx.Canned).where("error IS NULL").count() == 0


class Counted(fx.Canned):
    folder = ""

    def ask(self, model_id, prompt):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{model_id}|{prompt}")
        return super().ask(model_id, prompt)


def counted(folder):
    def connect(provider):
        client = Counted(provider)
        client.folder = folder
        return client

    return connect


def plain(df):
    return sorted(tuple(r) for r in df.select("question_id", "model", "text", "in_tok", "out_tok", "cost", "refused", "error").fillna("").collect())


def test_a_phase_broken_off_goes_on(spark, questions, models, tmp_path):
    whole = plain(phases.answers(questions, models, str(tmp_path / "whole"), "r1", fx.Canned, batches=5))
    assert len(whole) == 120
    calls, path = tmp_path / "calls", str(tmp_path / "parts")
    calls.mkdir()
    walk = phases.answer_batches(questions, models, path, "r1", counted(str(calls)), batches=5)
    next(walk)
    next(walk)
    walk.close()  # broken off between batches
    first = len(os.listdir(calls))
    there = phases.committed(spark, path, phases.ANSWERS, "r1").count()
    assert 0 < there < 120 and first == there
    # A part of a batch that was lost is asked for again, and its batch written anew as a whole.
    batch = phases.committed(spark, path, phases.ANSWERS, "r1").collect()
    phases.commit(spark.createDataFrame([tuple(r) for r in batch[:-3]], phases.ANSWERS), path, "batch")
    done = plain(phases.answers(questions, models, path, "r1", counted(str(calls)), batches=5))
    assert done == whole
    assert len(os.listdir(calls)) == 120 + 3
    phases.answers(questions, models, path, "r1", counted(str(calls)), batches=5)
    assert len(os.listdir(calls)) == 120 + 3  # nothing left to ask


def test_revisions_stand_apart_and_errors_can_be_asked_again(spark, questions, models, tmp_path):
    path = str(tmp_path / "a")
    first = plain(phases.answers(questions, models, path, "r1", fx.Canned, batches=2))
    assert plain(phases.answers(questions, models, path, "20240101", fx.Canned, batches=3)) == first
    assert plain(phases.committed(spark, path, phases.ANSWERS, "r1")) == first
    errors = sum(r[-1] != "" for r in first)

    class Mended(fx.Canned):
        def answer(self, model_id, prompt):
            return "mended"

    again = plain(phases.answers(questions, models, path, "r1", Mended, batches=2, again=True))
    assert errors and sum(r[2] == "mended" for r in again) == errors
    assert {r[:2] for r in again} == {r[:2] for r in first} and len(again) == 120


def test_evaluation_resumes_by_mode(spark, questions, models, tmp_path):
    few = questions.limit(6)
    given = phases.answers(few, models, str(tmp_path / "a"), "r1", fx.Canned, batches=1)
    rows = lambda df: sorted(tuple(r) for r in df.select("mode", "evaluator", "question_id", "model", "score_raw", "score", "error").fillna("").fillna(0).collect())
    whole = rows(phases.evaluations(few, given, models, str(tmp_path / "w"), "r1", fx.Canned))
    calls = tmp_path / "calls"
    calls.mkdir()
    walk = phases.evaluation_modes(few, given, models, str(tmp_path / "p"), "r1", counted(str(calls)))
    assert next(walk) == "shuffle_only"
    walk.close()
    assert len(os.listdir(calls)) == 18
    assert rows(phases.evaluations(few, given, models, str(tmp_path / "p"), "r1", counted(str(calls)))) == whole
    assert len(os.listdir(calls)) == 54
    assert {r[0] for r in whole} == set(phases.MODES)


def test_labels_of_replies(spark):
    from pyspark.sql import functions as F

    labelled = "array(named_struct('label', 'Response A', 'text', 't', 'model', 'm1'), named_struct('label', 'Response B', 'text', 't', 'model', 'm2'))"
    replies = {
        '{"Response A": {"score": 1}, "B": {"score": 2}}': {"m1": '{"score":1}', "m2": '{"score":2}'},
        '{"A": {"score": 3}, "Response A": {"score": 4}}': {"m1": '{"score":4}'},
        '{"nobody": {"score": 3}}': {},
        'Sure: ```json\n{"Response B": 7}\n```': {"m2": "7"},
        "[1, 2]": None,
        "no grades": None,
    }
    df = spark.createDataFrame([(t,) for t in replies], "t string").select("t", phases.read_cells(F.col("t"), F.expr(labelled)).alias("c"))
    assert {r.t: None if r.c is None else {x.model: x.cell for x in r.c} for r in df.collect()} == replies


def test_no_questions(spark, questions, models, tmp_path):
    none = phases.answers(questions.limit(0), models, str(tmp_path / "n"), "r1", fx.Canned)
    assert none.count() == 0 and phases.answer_totals(none).count() <= 1
    assert phases.evaluations(questions.limit(0), none, models, str(tmp_path / "m"), "r1", fx.Canned).count() == 0


class Shy(fx.Canned):
    """Makes up questions, each model in its own way; one fails at first, one always."""

    def ask(self, model_id, prompt):
        path = os.path.join(self.folder, model_id)
        tries = len(os.listdir(path)) if os.path.isdir(path) else 0
        os.makedirs(path, exist_ok=True)
        open(os.path.join(path, uuid.uuid4().hex), "w").close()
        if model_id == "a2" and tries < 2:
            return ("No idea.", 1, 1) if tries else ('{"questions": []}', 1, 1)
        if model_id == "b1":
            raise ValueError("invalid request")
        text = '[{"question": "q1"}, "loose", {"category": "c", "question": "q2"}, {"question": "q3"}]'
        return (text if model_id == "a1" else f'Here: ```json\n{{"questions": {text}}}\n```'), 1, 1


def test_questions_are_asked_for_until_there_are_some(spark, models, tmp_path):
    folder = str(tmp_path / "calls")
    os.makedirs(folder)

    def connect(provider):
        client = Shy(provider)
        client.folder = folder
        return client

    from pyspark.sql import functions as F

    got = phases.made_questions(models, F.lit("Write two."), str(tmp_path / "q"), "r1", connect, 2, attempts=4).collect()
    want = [("a1", 0, 0, "general", "q1"), ("a1", 0, 1, "c", "q2"), ("a2", 2, 0, "general", "q1"), ("a2", 2, 1, "c", "q2")]
    assert sorted((r.source_model, r.attempt, r.j, r.category, r.question) for r in got) == want
    assert {m: len(os.listdir(os.path.join(folder, m))) for m in os.listdir(folder)} == {"a1": 1, "a2": 3, "b1": 4}


def test_multiple_choice_from_questions_to_cells(spark, models, tmp_path):
    from gradecube.plans import validation
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(str(k), f"Question {k}?", [f"right {k}", "no", "never", f"wrong {k}"], 2) for k in range(30)], "question_id string, question string, choices array<string>, correct_index int")
    asked_of = validation.choice_questions(rows)
    for r in asked_of.collect():
        assert r.choices["ABCD".index(r.letter)] == f"right {r.question_id}" and f"{r.letter}. right {r.question_id}" in r.prompt
    assert {r.letter for r in validation.choice_questions(rows, shuffle=False).collect()} == {"C"}
    given = validation.choice_answers(asked_of, models, str(tmp_path / "a"), "r1", fx.Canned, letters="cascade", batches=2)
    out = given.collect()
    assert len(out) == 90 and {r.meant for r in out} == set("ABCD?") and all(r.meant == "?" for r in out if r.error or not r.text.strip())
    acc = {r.model: r for r in validation.accuracy(given).collect()}
    assert all(acc[m].correct == sum(r.correct for r in out if r.model == m) and acc[m].total == 30 for m in acc)
    few = asked_of.limit(3)
    long = given.withColumn("text", F.repeat(F.lit("x"), 900))
    seen = phases.shown(few, long, models, False, True, validation.SHOWN).first().labelled
    assert [x.label for x in seen] == ["Response A", "Response B", "Response C"] and {len(x.text) for x in seen} == {500}
    cells = validation.choice_evaluations(few, given, models, str(tmp_path / "c"), "r1", fx.Canned).collect()
    assert {r.mode for r in cells} == set(phases.MODES) and sum(r.score is not None for r in cells) > 20


def test_only_exact_labels(spark):
    from pyspark.sql import functions as F

    labelled = F.expr("array(named_struct('label', 'Response A', 'text', 't', 'model', 'm1'))")
    df = spark.createDataFrame([('{"A": {"score": 1}}',), ('{"Response A": 2}',)], "t string")
    assert [r[0] for r in df.select(F.size(phases.read_cells(F.col("t"), labelled, exact=True))).collect()] == [0, 1]


def test_a_search_keeps_its_first_results(spark):
    class Long(fx.Canned):
        def found(self, prompt):
            return "\n".join(["answer", "", "y" * 400, *map(str, range(9))])

    q = spark.createDataFrame([("1", "Who?", "CURRENT events"), ("2", "Why?", None), ("3", "What?", "history")], "question_id string, question string, category string")
    out = {r.question_id: r for r in phases.fetched(q, Long, "search", 0.01, results=3).collect()}
    assert out["1"].grounding == "answer " + "y" * 250 + " 0" and out["1"].success and out["1"].cost == 0.01
    assert out["2"].skipped and out["3"].skipped and out["2"].success is None and out["3"].grounding is None


def test_a_session_leaves_out_who_did_not_answer(spark, models, tmp_path):
    class Quiet(fx.Canned):
        def answer(self, model_id, prompt):
            if model_id == "a2":
                raise ValueError("invalid request")
            return " " if model_id == "b1" and "blank" in prompt else f"Answer of {model_id}."

        def grades(self, model_id, prompt):
            assert "N/A" not in prompt and "Answer of a2" not in prompt
            return json.dumps({label: {"score": 8} for label in __import__("re").findall(r"^--- (.+) ---$", prompt, __import__("re").M)})

    q = spark.createDataFrame([("q", "What?"), ("r", "A blank?")], "question_id string, question string")
    given, cells = phases.session(q, models, str(tmp_path), "r1", Quiet, modes=["shuffle_blind"])
    assert {(r.question_id, r.model): (r.error, r.refused) for r in given.collect()}["q", "a2"] == ("invalid request", False)
    got = sorted((r.mode, r.question_id, r.evaluator, r.model, r.score) for r in cells.collect())
    assert got == [("shuffle_blind", "q", e, m, 8.0) for e in ("a1", "b1") for m in ("a1", "b1")] + [("shuffle_blind", "r", "a1", "a1", 8.0)]


def test_a_reply_is_parsed_once_whatever_it_holds(spark):
    from pyspark.sql import functions as F

    labelled = "array(" + ", ".join(f"named_struct('label', 'Response {x}', 'text', '', 'model', 'm{x}')" for x in "ABCDE") + ")"
    df = spark.createDataFrame([('{"A": 1, "Response A": 2, "Response B": {"score": 3}, "Z": 4}',), (None,), ("none",)], "t string")
    cells = df.select(phases.read_cells(F.col("t"), F.expr(labelled)).alias("c"))
    assert [r.c and sorted(map(tuple, r.c)) for r in cells.collect()] == [[("mA", "2"), ("mB", '{"score":3}')], None, None]
    plan = cells._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json") == 1


def test_answers_of_all_batches_take_one_search_a_question(spark, monkeypatch, tmp_path):
    folder = tmp_path / "asked"
    folder.mkdir()

    class Counted(queries.fx.Canned):
        def found(self, prompt):
            (folder / uuid.uuid4().hex).touch()
            return super().found(prompt)

    monkeypatch.setattr(queries.fx, "Canned", Counted)
    _, log = queries.phase_answers(spark, "/root/testdata/sf0.001")
    assert len(list(folder.iterdir())) == log.where("NOT skipped").count() > 0
