"""Hand-computed and small-scale checks of the operators, with nulls, empty tables and clashing columns."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from inkvane.operators import analyze, builders, decision, detector, evaluate, experiment, features, metrics, scorers, splits
from inkvane.sources import files, schema, synthetic


def one(df):
    return df.collect()[0].asDict()


def test_features_by_hand(spark):
    r = one(features.statistical(spark.createDataFrame([("The cat ran. It won!",)], "text string"), common=["cat"]))
    assert (r["sent_count"], r["sent_mean_len_words"], r["sent_std_len_words"]) == (2, 2.5, 0.5)
    assert r["sent_len_words_cv"] == pytest.approx(0.2) and r["sent_len_words_burstiness"] == pytest.approx(-2 / 3)
    assert r["lex_ttr"] == r["lex_hapax_ratio"] == r["rep_distinct_2"] == 1.0 and r["rep_top_bigram_share"] == 0.25
    assert r["style_stopword_ratio"] == pytest.approx(2 / 5) and r["style_common_word_ratio"] == pytest.approx(3 / 5)
    assert r["style_punct_char_ratio"] == pytest.approx(2 / 16)


def test_features_of_nothing(spark):
    rows = features.statistical(spark.createDataFrame([(None, 1), ("", 2), (" \n", 3)], "text string, label int")).collect()
    for r in rows:
        assert r["sent_count"] == r["lex_ttr"] == r["style_stopword_ratio"] == 0.0 and r["rep_distinct_1"] == 1.0
    assert features.statistical(spark.createDataFrame([], "text string")).count() == 0


def test_mattr_is_the_mean_of_windows(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefghijk") * 2 for _ in range(130)]
    want = sum(len(set(words[i : i + 50])) / 50 for i in range(81)) / 81
    r = one(features.statistical(spark.createDataFrame([(" ".join(words),)], "text string"), groups=("lexical",)))
    assert r["lex_mattr_w50"] == pytest.approx(want, abs=1e-12)


def test_scorers(spark):
    from inkvane.functions import text as tx

    tok = tx.explode_words(spark.createDataFrame([("d", "Aa bb. Cc aa")], "id string, text string"), "id")
    lex = spark.createDataFrame([("AA", -1.0, 0.5), ("bb", -3.0, None), (None, -9.0, 1.0)], "token string, logprob double, entropy double")
    scored = scorers.lexicon(tok, lex)
    assert sorted(r["logprob"] for r in scored.collect()) == [-3.0, -2.0, -1.0, -1.0]
    r = one(features.perplexity(scored, "id"))
    assert r["ppl_doc_perplexity"] == pytest.approx(math.exp(7 / 4)) and r["ppl_has_entropy"] == 1.0 and r["ppl_entropy_mean"] == 0.5
    assert scorers.blake2_unit("0:g1") == pytest.approx(0.923378345243649, abs=1e-15)
    s = {x["word"]: x["logprob"] for x in scorers.stub(tok).collect()}
    assert s["Aa"] == s["aa"] and all(-5 <= v <= -1 for v in s.values())
    assert sum(math.exp(v) * n for v, n in {(x["logprob"], 1) for x in scorers.unigram(tok).collect()}) == pytest.approx(0.75)
    with pytest.raises(ValueError):
        scorers.make("nonsense")
    with pytest.raises(ValueError):
        scorers.stub(tok, spread=-1)


def test_splits(spark):
    df = spark.createDataFrame([(i, f"g{i // 2}" if i else None, "old", 7) for i in range(40)], "id int, group_id string, split string, u int").drop("u")
    out = splits.assign_splits(df).collect()
    assert len(out) == 40 and splits.leaks(splits.assign_splits(df)).count() == 0
    assert all((r["split"] is None) == (r["group_id"] is None) for r in out)
    assert {r["split"] for r in splits.assign_splits(df.where("group_id = 'g1'")).collect()} == {"test" if scorers.blake2_unit("0:g1") >= 0.8 else "train"}
    with pytest.raises(ValueError):
        splits.assign_splits(df, train=0.5, val=0.1, test=0.1)
    f = spark.createDataFrame([("a", "g", "ai", "x"), ("b", "g", "ai", "y"), ("c", "h", "human", None)], "id string, group_id string, label string, model_family string")
    assert {r["id"]: r["split"] for r in splits.family_holdout(f, ["x"]).where("label = 'ai'").collect()} == {"a": "test", "b": "train"}


def test_metrics(spark):
    rng = random.Random(1)
    data = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(data, "y int, p double")
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert one(metrics.auroc(df))["auroc"] == pytest.approx(want)
    assert one(metrics.auroc(df.withColumn("g", F.lit(1)), by=["g"]))["auroc"] == pytest.approx(want)
    assert one(metrics.auroc(df.where("y = 1")))["auroc"] is None
    edge = spark.createDataFrame([(1, 0.3), (0, 0.6), (1, 0.7), (1, 1.0)], "y int, p double")
    assert {r["bin"]: r["count"] for r in metrics.calibration(edge).collect()} == {2: 1, 5: 1, 6: 1, 9: 1}
    m = one(metrics.confusion(spark.createDataFrame([(0, 0.1), (1, 0.5), (1, 0.2)], "y int, p double")))
    assert (m["tp"], m["fn"], m["tn"], m["precision"], m["recall"]) == (1, 1, 1, 1.0, 0.5)
    assert one(metrics.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b"))["r"] == 0.0
    assert metrics.classification(df.where("false")).count() == 1


def test_decision(spark):
    rows = [("low", 0.52, 0.0), ("mixed", 0.65, 0.2), ("edge", 0.85, 0.10), ("flat", 0.65, 0.05)]
    df = spark.createDataFrame([(k, i, m + (d if i % 2 else -d)) for k, m, d in rows for i in range(4)], "id string, sid int, p_ai double")
    got = {r["id"]: r for r in decision.aggregate(df, "id").collect()}
    assert got["low"]["label"] == "human" and got["low"]["p_ai"] > got["low"]["p_human"]
    assert got["mixed"]["label"] == "mixed" and got["mixed"]["p_mixed"] == pytest.approx(0.9)
    assert got["flat"]["label"] == "ai" and got["flat"]["p_mixed"] == 0.0
    doc = spark.createDataFrame([("mixed", 0.1)], "id string, doc_p double")
    assert {r["id"]: r["label"] for r in decision.aggregate(df, "id", doc_p=doc).collect()}["mixed"] == "human"
    assert decision.aggregate(spark.createDataFrame([("a", None)], "id string, p_ai double"), "id").count() == 0
    with pytest.raises(ValueError):
        decision.Rule(low=0.9)


def test_detector(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i % 2, 3.0 * (i % 2) + rng.gauss(0, 1), rng.gauss(0, 1), 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, y int, signal double, noise double, flat double")
    m = detector.train(df, ["signal", "noise", "flat"])
    assert m.importances(1)[0][0] == "signal" and m.scale[2] == 1.0
    # the gradient of the penalised loss vanishes
    z = [[(r[2 + k] - m.center[k]) / m.scale[k] for k in range(3)] for r in rows]
    p = [detector.sigmoid_scalar(m.intercept + sum(w * x for w, x in zip(m.coef, v))) for v in z]
    for k in range(3):
        assert sum((a - r[1]) * v[k] for a, r, v in zip(p, rows, z)) + m.coef[k] == pytest.approx(0, abs=1e-3)
    acc = m.predict(df).where((F.col("p_ai") >= 0.5) == (F.col("y") == 1)).count() / 120
    assert acc > 0.85
    path = str(tmp_path / "m.json")
    m.save(path)
    assert detector.Detector.load(path) == m
    bad = json.loads(open(path).read()) | {"format_version": 9}
    (tmp_path / "b.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError):
        detector.Detector.load(str(tmp_path / "b.json"))
    with pytest.raises(ValueError):
        m.predict(df.drop("noise"))
    f = detector.folds(df, 3, "y", "id").groupBy("fold", "y").count().collect()
    assert sorted(r["count"] for r in f) == [20] * 6


def test_schema_rules(spark):
    g = {"model_family": "f", "model_name": "m", "provider": None, "temperature": 0.5, "top_p": 0.5, "prompt_id": None, "prompt_summary": None}
    ok = ("a", "Hello there", "human", [], "s", "g", None, None, None, {})
    rows = [ok, ("", *ok[1:]), ("m1", "Hello there", "mixed", [(0, 5, "human")], "s", "g", g, None, None, {}), ("m2", "Hello", "mixed", [(0, 4, "human"), (3, 9, "ai")], "s", "g", g, None, None, {}),
            ("h", "x", "human", [(0, 1, "human")], "s", "g", g, None, "dev", {}), ("i", "x", "ai", [], "s", "g", None, None, None, {}), ("j", "x", "ai", [], "s", "g", g | {"temperature": -1.0, "top_p": 2.0}, None, None, {}), ("k", None, None, None, None, None, None, None, None, None), ok]
    got = {}
    for r in schema.violations(spark.createDataFrame(rows, schema.RECORD)).collect():
        got.setdefault(r["id"], set()).add(r["reason"])
    assert got["a"] == {"duplicate id"} and got[""] == {"id is empty"} and got["m1"] == {"mixed needs spans of both kinds"}
    assert got["m2"] == {"span past the text", "spans overlap or are out of order"} and got["i"] == {"generation missing"}
    assert got["h"] == {"pure record has spans", "human record has generation", "unknown split"} and got["j"] == {"temperature out of range", "top_p out of range"}
    assert {"text is empty", "unknown label"} <= got["k"]
    with pytest.raises(ValueError):
        schema.validate(spark.createDataFrame(rows, schema.RECORD))


def test_files(spark, tmp_path):
    corpus = synthetic.corpus(spark, human=6, ai=6, paraphrases=2, mixed=2)
    assert schema.violations(corpus).count() == 0
    out = str(tmp_path / "c")
    assert files.write_jsonl(corpus, out) == 16
    back = files.read_jsonl(spark, out)
    assert sorted(map(str, back.select("id", "text", "spans", "label").collect())) == sorted(map(str, corpus.select("id", "text", "spans", "label").collect()))
    (tmp_path / "two.jsonl").write_text('{"id":"x","text":"t"}\n\n{"id":"x","text":"u"}\nnot json\n')
    with pytest.raises(Exception, match=r"two\.jsonl:\d"):
        files.read_jsonl(spark, str(tmp_path / "two.jsonl")).collect()
    (tmp_path / "rule.jsonl").write_text('{"id":"x","text":"t","label":"human","source":"s","group_id":"g"}\n{"id":"y","text":"","label":"human","source":"s","group_id":"g"}\n')
    with pytest.raises(Exception, match=r"rule\.jsonl:2: text is empty"):
        files.read_jsonl(spark, str(tmp_path / "rule.jsonl"), unique=False).count()
    assert files.read_jsonl(spark, str(tmp_path / "rule.jsonl"), validate=False).count() == 2
    lines = files.read_jsonl_lines(spark, str(tmp_path / "two.jsonl")).orderBy("line_no").collect()
    assert [r["line_no"] for r in lines] == [1, 3, 4] and lines[2]["error"].endswith("two.jsonl:4")
    (tmp_path / "t").mkdir()
    for n, t in (("b", " hi \n"), ("a", "x"), ("blank", " \n")):
        (tmp_path / "t" / f"{n}.txt").write_text(t)
    assert [(r["id"], r["text"], r["generation"]["model_family"]) for r in files.read_text_folder(spark, str(tmp_path / "t"), "ai", "s", "p-").orderBy("id").collect()] == [("p-a", "x", "unknown"), ("p-b", "hi", "unknown")]
    (tmp_path / "f.jsonl").write_text('{"body":" Hi ","kind":"machine","temp":"0.7"}\n\n{"body":"Yo","kind":"person"}\n{"body":" ","kind":"person"}\n')
    m = files.FieldMap(text="body", source="s", label_field="kind", label_map={"machine": "ai", "person": "human"}, temperature="temp")
    got = files.read_field_map(spark, str(tmp_path / "f.jsonl"), m).orderBy("id").collect()
    assert [(r["id"], r["text"], r["label"], r["generation"] and r["generation"]["temperature"]) for r in got] == [("f-1", "Hi", "ai", 0.7), ("f-3", "Yo", "human", None)]
    with pytest.raises(ValueError):
        files.FieldMap(text="body", source="s")
    with pytest.raises(Exception, match="unmapped label"):
        files.read_field_map(spark, str(tmp_path / "f.jsonl"), files.FieldMap(text="body", source="s", label_field="kind", label_map={"machine": "ai"})).collect()
    (tmp_path / "m.csv").write_text('text,label,src\n"﻿ a ""q""\nb ",0,x_human\nshort,1\n')
    assert [tuple(r) for r in files.read_labelled_csv(spark, str(tmp_path / "m.csv")).collect()] == [('a "q"\nb', "0", "x_human")]
    long = " ".join(f"Sentence number {i} is here." for i in range(20))
    (tmp_path / "p.jsonl").write_text(json.dumps({"human_answers": ["no", long], "chatgpt_answers": [long]}) + "\n" + json.dumps({"id": "q", "human_answers": [], "chatgpt_answers": [long]}) + "\n")
    assert [(r["id"], r["human"] == long) for r in files.read_answer_pairs(spark, str(tmp_path / "p.jsonl")).collect()] == [("0", True)]


def test_source_names(spark):
    df = spark.createDataFrame([("yelp_human",), ("cmv_machine_topical_gpt_j",), ("odd",), (None,)], "s string")
    got = [tuple(r["x"]) for r in df.select(files.parse_src(F.col("s")).alias("x")).collect()][:3]
    assert got == [("yelp", None), ("cmv", "gpt_j"), ("odd", "unknown")]
    fam = [r[0] for r in spark.createDataFrame([("text-davinci-003",), ("GLM130B",), ("_7B",), ("gpt_neox",), ("t0_3b",), ("zzz",)], "m string").select(files.model_family(F.col("m"))).collect()]
    assert fam == ["gpt-3.5", "glm", "llama", "eleutherai", "bigscience", "other"]


def test_builders(spark):
    t = "Many old houses look big. However, night is very beautiful. Very quick end."
    df = spark.createDataFrame([("a", t), ("n", None)], "id string, text string")
    got = [r[0] for r in df.orderBy("id").select(builders.paraphrase(F.col("text"), F.col("id"))).collect()]
    assert got[1] is None and got[0] != t and got[0].split()[-1] == "end." or got[0].split()[-1] == "finish."
    pairs = spark.createDataFrame([(k, "H one. H two. H three. H four.", "A one. A two.") for k in "pqr"] + [("z", "", "A one.")], "id string, h string, a string")
    mixed = builders.mix(pairs, "id", "h", "a").collect()
    assert sorted(r["id"] for r in mixed) == ["p", "q", "r"]
    for r in mixed:
        spans = [tuple(s) for s in r["spans"]]
        assert all(a[2] != b[2] and b[0] == a[1] + 1 for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(r["text"])
        for side, letter in (("human", "H"), ("ai", "A")):
            assert " ".join(r["text"][s:e] for s, e, k in spans if k == side).split(". ")[0].startswith(letter)
    with pytest.raises(Exception, match="mixed"):
        builders.paraphrase_records(spark.createDataFrame([("m", "t", "mixed", None)], "id string, text string, label string, transform string")).collect()
    rr = builders.round_robin(spark.createDataFrame([(i, "ab"[i % 4 == 0]) for i in range(20)], "id int, c string"), "c", "id", 5).collect()
    assert sorted(r["c"] for r in rr) == ["a", "a", "b", "b", "b"] or sorted(r["c"] for r in rr) == ["a", "a", "a", "b", "b"]


def test_truth_and_families(spark):
    df = spark.createDataFrame([("human", None, 0, 4), ("ai", None, 0, 4), ("mixed", [(0, 10, "human"), (10, 20, "ai")], 8, 12), ("mixed", [(0, 10, "human"), (10, 20, "ai")], 6, 12), ("odd", None, 0, 1)], "label string, spans array<struct<start:int,end:int,label:string>>, s int, e int")
    assert [r[0] for r in df.select(evaluate.truth(F.col("label"), F.col("spans"), F.col("s"), F.col("e"))).collect()] == [0, 1, 1, 0, None]
    sc = spark.createDataFrame([("human", None, 0.2), ("human", None, 0.6), ("ai", "x", 0.9), ("ai", "y", 0.4), ("ai", None, 0.1)], "label string, model_family string, p double")
    assert {r["model_family"]: (r["n"], r["auroc"]) for r in evaluate.by_family(sc).collect()} == {"x": (3, 1.0), "y": (3, 0.5)}


def test_experiment_end_to_end(spark, tmp_path):
    corpus = synthetic.corpus(spark, human=24, ai=24, paraphrases=4, mixed=6)
    cfg = experiment.Config("demo", "-", str(tmp_path / "out"), scorer="none", ablations=["style_only"], holdout_families=["gamma"])
    r = experiment.run(corpus, cfg)
    a = r["ablations"]["style_only"]
    assert a["seen"][0]["auroc"] > 0.9 and a["unseen_family"]["gamma"][0]["n"] > 0 and (tmp_path / "out" / "results.json").exists()
    assert experiment.plot_data(r)[0][0] == "style_only"
    for bad in ("nope", "perplexity_only"):
        with pytest.raises(ValueError):
            experiment.names_of(bad, "none")


def test_registry_and_rejections(spark):
    m = detector.Detector(["sent_count"], [1.0], [1.0], [0.5], 0.0)
    reg = analyze.Registry()
    reg.add(analyze.System("demo", m))
    assert reg.get().name == "demo" and reg.health()["detectors"] == 1 and reg.detectors()[0]["features"] == 1
    with pytest.raises(KeyError):
        reg.get("other")
    with pytest.raises(ValueError):
        reg.add(analyze.System("bad", detector.Detector(["ppl_doc_perplexity"], [0.0], [1.0], [1.0], 0.0)))
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "  "), (4, "x" * 50001)], "id int, text string")
    got = {r["id"]: (r["reason"], r["label"]) for r in analyze.analyze(df, reg.get()).collect()}
    assert got[2][0] == "missing" and got[3][0] == "blank" and got[4][0] == "too long" and got[1][0] is None and got[1][1]


def test_long_texts_of_batch_tables(spark, monkeypatch):
    from inkvane.plans import queries

    docs = spark.createDataFrame([(1, "One two. " * 5600), (2, " ")], "doc_id int, text string")
    one = analyze.System("demo", detector.Detector(["sent_count"], [1.0], [1.0], [0.5], 0.0))
    monkeypatch.setattr(queries, "_docs", lambda *_: docs)
    monkeypatch.setattr(queries, "read_table", lambda *_: None)
    monkeypatch.setattr(queries, "_labelled", lambda *_: None)
    monkeypatch.setattr(queries.detector, "distributions", lambda *_: spark.createDataFrame([], "label string, feature string, mean double, std double"))
    monkeypatch.setattr(queries.analyze, "System", lambda *_, **__: one)
    got = {r["doc_id"]: (r["reason"], r["label"]) for r in queries.analyze_bundle(spark, "").collect()}
    assert got[1][0] is None and got[1][1] and got[2] == ("blank", None)


def test_streaming(spark, tmp_path):
    from inkvane.streaming import scoring

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":"a","text":"One. Two."}\n{"id":"b","text":null}\n')
    m = detector.Detector(["sent_count"], [1.0], [1.0], [0.5], 0.0)
    q = scoring.score(scoring.read(spark, str(tmp_path / "in")), m).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: round(r["p_ai"], 3) for r in spark.sql("select id, p_ai from scored").collect()} == {"a": 0.622, "b": 0.378}


def test_stand_in(spark):
    from inkvane.operators import standin

    df = spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else "delta epsilon", i % 2) for i in range(40)] + [(99, None, None)], "id int, sentence string, y int")
    got = standin.predict(standin.fit(df), df).collect()
    assert all((r["p_ai"] > 0.5) == bool(r["y"]) for r in got if r["y"] is not None) and len(got) == 41
    with pytest.raises(ValueError):
        standin.fit(df.where("y = 1"))


def test_cli(capsys):
    from inkvane import cli

    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == cli.VERSION
    with pytest.raises(SystemExit):
        cli.main(["features"])
    with pytest.raises(SystemExit):
        cli.main(["evaluate", "a", "b", "--split", "odd"])


def test_line_numbers_over_splits(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 10)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"id":"{name}{i}"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_jsonl_lines(spark, str(tmp_path)).select("path", "line_no", "id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 4010
    for r in rows:
        i = int(r["id"][1:])
        assert r["line_no"] == i + 1 + (i + 6) // 7


def test_midpoints(spark):
    sents = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 11, 20), ("b", 0, 5, 8)], "id string, sid int, start int, end int")
    toks = spark.createDataFrame([("a", 8, 11, "x"), ("a", 9, 12, "y"), ("a", 10, 13, "z"), ("b", 0, 4, "before"), ("b", 5, 9, "in"), ("c", 0, 1, "none"), ("b", 7, 9, "out")], "id string, start int, end int, word string")
    got = {(r["id"], r["word"]): r["sid"] for r in scorers.attribute(toks, sents, "id").collect()}
    assert got == {("a", "x"): 0, ("a", "z"): 1, ("b", "in"): 0}
    halves = scorers.external(lambda texts: [[{"text": t[i : i + 3], "start": i, "end": min(len(t), i + 3), "logprob": -1.0, "entropy": None} for i in range(0, len(t), 3)] for t in texts])
    rows = halves(spark.createDataFrame([("a", "Ab cd. Ef gh."), ("n", None)], "id string, text string"), "id").collect()
    assert {(r["start"], r["sid"]) for r in rows} == {(0, 0), (3, 0), (6, 1), (9, 1), (12, 1)}


def test_signal_overlap(spark):
    a = spark.createDataFrame([("d", i, 0.1 * i) for i in range(5)] + [("e", 0, 0.9)], "id string, sid int, p double")
    b = a.withColumn("p", 1 - F.col("p"))
    f = a.select("id", "sid", (F.col("p") * 2).alias("x"), F.lit(1.0).alias("flat"))
    got = {r["signal"]: (r["n"], round(r["r"], 9)) for r in experiment.overlap(a, b, f, ["id", "sid"], ("x", "flat")).collect()}
    assert got == {"neural_vs_classical_prob": (6, -1.0), "neural_vs_x": (6, 1.0), "neural_vs_flat": (6, 0.0)}
    assert experiment.overlap(a, b, f, ["id", "sid"], ("x",), first=1).collect()[0]["n"] == 5
    with pytest.raises(Exception, match="one system only"):
        experiment.overlap(a, b.where("sid < 4"), f, ["id", "sid"], ("x",)).collect()


def test_robustness_report(spark):
    sc = spark.createDataFrame([("human", None, 0.2), ("human", None, 0.6), ("ai", "x", 0.9), ("ai", "y", 0.4)], "label string, model_family string, p double")
    sents = spark.createDataFrame([("mixed", [(0, 10, "ai")], 0, 5, 0.8), ("mixed", [(0, 10, "ai")], 12, 15, 0.1)], "label string, spans array<struct<start:int,end:int,label:string>>, start int, end int, p double")
    dec = spark.createDataFrame([("mixed", "mixed"), ("mixed", "ai"), ("ai", "ai")], "truth string, label string")
    got = {r["slice"]: r for r in evaluate.robustness(sc, sents, dec, sc.where("p < 0.7"), sc.where("false")).collect()}
    assert set(got) == {"seen_overall", "family:x", "family:y", "localization", "mixed_doc_labels", "ood", "ood_paraphrased"}
    assert got["family:x"]["auroc"] == 1.0 and got["localization"]["auroc"] == 1.0 and got["mixed_doc_labels"]["frac_labelled_mixed"] == 0.5
    assert got["ood"]["n"] == 3 and got["ood_paraphrased"]["n"] == 0


def test_quantiles_across_partitions(spark):
    import numpy as np

    rng = random.Random(8)
    rows = [("ab"[i % 3 == 0], rng.choice([0.0, 1.0, rng.random()]), float(i % 5)) for i in range(997)]
    got = {(r["label"], r["feature"]): r for r in detector.distributions(spark.createDataFrame(rows, "label string, u double, v double").repartition(7), ["u", "v"]).collect()}
    for k, (c, name) in enumerate([("a", "u"), ("b", "u"), ("a", "v"), ("b", "v")]):
        x = [r[1 if name == "u" else 2] for r in rows if r[0] == c]
        for q, v in detector.QUANTILES.items():
            assert got[c, name][q] == pytest.approx(np.quantile(x, v))
