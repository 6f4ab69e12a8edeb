import random

import corpus_pipeline as C


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(5)
    vocabulary = "the cat sat on a mat and saw dogs run home while rain fell over old stone walls near quiet fields of green wheat beyond small towns".split()
    prose = lambda n: " ".join(rnd.choices(vocabulary, k=n)) + "."
    rows = [(k, prose(rnd.randint(60, 120)), "en", f"src{k % 3}") for k in range(90)]
    item = prose(30)
    rows += [(100, rows[0][1], "en", "src0"), (101, rows[1][1].replace("cat", "cat", 1) + " end", "en", "src0")]
    rows += [(102, "%%% &&& ### " * 40, "en", "src1"), (103, prose(40) + " " + item + " " + prose(40), "en", "src1"), (104, prose(250) + " mail ann.lee@mail.example.com now " + prose(250), "en", "src2"), (105, None, None, None)]
    docs = [(i, t, la, s, len(t) if t else None) for i, t, la, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 90, 2)] + [(102, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{sf}/{name}")
        d = spark.read.parquet(f"{sf}/{name}")
        seen[name] = {r.doc_id: r for r in d.collect()}
    first, second, third, fourth = seen.values()
    assert set(range(90)) - set(first) == set() or len(set(range(90)) - set(first)) <= 2
    assert 102 not in first and 105 not in first and 103 in first
    assert 100 not in second and 101 not in second and len(second) >= len(first) - 3
    assert set(second) - set(third) == {103}
    assert set(fourth) == set(third) and "ann.lee" not in fourth[104].text and fourth[104].n_chars == len(fourth[104].text)
    last = C.STAGES[-1][1](spark, d, sf).collect()
    assert last and all(r.copies > 0 for r in last) and {r.doc_id for r in last} <= set(fourth)
    whole = C.run(spark, sf)
    assert {r.doc_id: r.text for r in whole.collect()}.items() <= {k: r.text for k, r in fourth.items()}.items()


def test_empty_tables_and_odd_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, kind in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
    item = " ".join(f"word{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"before {item} after", "en", "a", 1), (None, "clean text", "en", "a", 1), (7, item, "en", "a", 1), (7, "other text", None, None, None), (8, None, "en", "a", 0)]
    out = C.benchmark_decontamination(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    assert sorted(str(r.text) for r in out.collect()) == ["None", "clean text", "other text"]
