"""Discovery and the whole analysis on a small survey; sources, sinks, state, streaming."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.operators import backends, discover
from answerloom.plans import cli, pipeline
from answerloom.sources import sinks, state, synthetic, tables
from answerloom.sources.config import Config, deep_merge

SETTINGS = {
    "input": {"question_col": "question", "text_col": "text", "non_answer_regex": "n/a|nothing|no complaints"},
    "themes": {"n_themes": 6, "min_theme_clauses": 5, "word_min_df": 3, "required": [{"name": "Not Specific", "general": True, "seeds": ["it is good", "i like it", "not for me"]}]},
    "assign": {"min_sim": 0.35},
}


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    table = synthetic.survey_table(spark, 240)
    return pipeline.run(spark, table, Config(SETTINGS), folder, "survey"), folder, table


def test_topics_are_found(done):
    run, _, _ = done
    themes = run.themes["ALL"]
    names = " ".join(t.name.lower() for t in themes)
    assert sum(topic in names for topic in synthetic.TOPICS) >= 4, names
    assert [t.name for t in themes if t.general] == ["Not Specific"]
    assert all(len(t.extra["representatives"]) <= 3 for t in themes)


def test_every_clause_has_a_theme(done):
    run, _, _ = done
    assert run.clauses.join(run.assigned, "clause_id", "left_anti").count() == 0
    assert {r.via for r in run.assigned.select("via").distinct().collect()} <= {"both", "semantic", "keyword", "fallback"}


def test_result(done):
    run, _, table = done
    assert run.result.count() == table.count()
    rated = [c for c in run.result.columns if c not in ("row_id", "Like", "Dislike")]
    assert len(rated) == 2 * (1 + len(run.themes["ALL"]))
    labels = {v for r in run.result.select(*[F.col(f"`{c}`") for c in rated]).collect() for v in r if v is not None}
    assert labels <= {"Positive", "Negative", "Neutral"} and "Positive" in labels and "Negative" in labels
    assert run.report["ALL"]["summary"]["n_themes"] == len(run.themes["ALL"]) - 1


def test_second_run_reads_what_is_there(spark, done):
    run, folder, table = done
    again = pipeline.run(spark, table, Config(SETTINGS), folder, "survey", until="assign")
    assert {"ingest", "segment", "embed", "themes", "assign"} <= set(again.cached)
    assert [t.name for t in again.themes["ALL"]] == [t.name for t in run.themes["ALL"]]
    a, b = ({(r.clause_id, r.theme_idx) for r in x.assigned.collect()} for x in (run, again))
    assert a == b


def test_keys_follow_what_they_depend_on():
    models = {"embed": "m", "overall": "s", "aspects": "s"}
    one = pipeline.stage_keys(Config(SETTINGS), "f", models)
    two = pipeline.stage_keys(Config(deep_merge(SETTINGS, {"output": {"evidence_threshold": 0.7}})), "f", models)
    three = pipeline.stage_keys(Config(deep_merge(SETTINGS, {"segment": {"min_words": 3}})), "f", models)
    assert one == two and one["ingest"] == three["ingest"] and one["segment"] != three["segment"] != one["aspects"]


def test_fewer_groups_and_more(spark):
    rng = np.random.default_rng(0)
    rows = [(k, (np.eye(4)[k % 4 if k < 80 else 0] + 0.1 * rng.normal(size=4)).tolist(), k % 4 if k < 80 else 0) for k in range(100)]
    groups = spark.createDataFrame(rows, "clause_id long, vec array<double>, cluster int")
    rules = discover.DiscoverRules()
    assert discover.fold_small(groups, 2).select("cluster").distinct().count() == 2
    more = discover.split_to_count(groups, 5, rules)
    assert more.select("cluster").distinct().count() == 5 and more.count() == 100
    assert discover.fingerprint(groups.withColumn("clause_key", F.col("clause_id").cast("string")), rules, backends.HashEmbedder()) == discover.fingerprint(groups.repartition(7).withColumn("clause_key", F.col("clause_id").cast("string")), rules, backends.HashEmbedder())


def test_dense_groups_and_topic_words(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "price thing" if k % 3 else "smell thing", (np.eye(3)[k % 3] + 0.05 * rng.normal(size=3)).tolist()) for k in range(90)]
    df = spark.createDataFrame(rows, "clause_id long, clause string, vec array<double>")
    found = discover.dense_groups(df, discover.DiscoverRules(), 2, 5).groupBy("cluster").agg(F.countDistinct(F.col("clause_id") % 3).alias("kinds"), F.count("*").alias("n")).collect()
    assert sorted((r.kinds, r.n) for r in found) == [(1, 30)] * 3
    moved = discover.with_topic_words(df, backends.HashEmbedder(3), discover.DiscoverRules())
    assert moved.columns == ["clause_id", "clause", "vec"] and all(abs(np.linalg.norm(r.vec) - 1) < 1e-6 for r in moved.collect())


def test_words_of_judgement(spark):
    rows = [(f"w{k}", [1.0, 0.01 * k]) for k in range(10)] + [("nice", [0.1, 1.0])]
    words = spark.createDataFrame(rows, "word string, vec array<double>")
    axis = np.array([0.0, 1.0])
    assert {r.word for r in discover.opinion_words(words, axis).collect()} == {"nice", "nices"}
    assert discover.opinion_words(words.limit(3), axis).count() == 0
    assert "product" in discover.noise_words("hybrid", {"nice"}) and discover.noise_words("data", {"nice"}) == {"nice"}
    assert discover.noise_words("fixed") - discover.noise_words("language") == discover.SURVEY_WORDS


def test_sharpened():
    from answerloom.operators.assign import Theme

    t = [Theme("a", np.array([1.0, 0.0]))]
    assert discover.sharpened(t, {"a": np.array([0.0, 1.0])})[0].centre == pytest.approx([0.5**0.5, 0.5**0.5])
    with pytest.raises(ValueError):
        discover.sharpened(t, {"b": np.array([0.0, 1.0])})


def test_form_settings():
    from answerloom.plans.curation import build_settings, name_taken

    s = build_settings(8, [{"name": "Price"}], {"name": "General", "general": True}, {"q1": "praise", "q2": "auto", "q3": "off"})
    assert s["themes"]["n_total"] == 10 and set(s["output"]["question_polarity"]) == {"q1", "q3"}
    assert name_taken(" price", ["Price"]) and not name_taken("cost", ["Price"])


def test_too_few_clauses(spark):
    df = spark.createDataFrame([(1, "k", "one two", [1.0, 0.0])], "clause_id long, clause_key string, clause string, vec array<double>")
    with pytest.raises(ValueError):
        discover.discover(df, discover.DiscoverRules(), backends.HashEmbedder(2))


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Source;Text\nLike;café, très bon\nDislike;None\n".encode("cp1252"))
    rows = tables.read_table(spark, f"file://{tmp_path}/a.csv").collect()
    assert [tuple(r) for r in rows] == [("Like", "café, très bon"), ("Dislike", "None")]
    (tmp_path / "b.csv").write_bytes("Text\nfirst\nsecond\n".encode("utf-8-sig"))
    df = tables.read_table(spark, f"file://{tmp_path}/b.csv")
    assert df.columns == ["Text"] and df.count() == 2
    (tmp_path / "c.csv").write_text("export,1\nq,text\nx,hello\n")
    assert [tuple(r) for r in tables.read_table(spark, f"file://{tmp_path}/c.csv", header_row=1).collect()] == [("x", "hello")]


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & b <c>", True), (2, None, False)], "id long, text string, flag boolean")
    path = f"{tmp_path}/book.xlsx"
    sinks.write_workbook({"results": df, "A question?": df.select("text")}, path)
    assert tables.sheet_names(path) == ["results", "A question"] and zipfile.ZipFile(path).testzip() is None
    back = tables.read_table(spark, path, sheet="results")
    assert back.columns == ["id", "text", "flag"] and [r.text for r in back.collect()] == ["a & b <c>", None]
    assert sinks.sheet_name("results") == "results (Q)" and len(sinks.sheet_name("x" * 50)) == 31


def test_vector_cache(spark, tmp_path):
    calls = []

    class Counting(backends.HashEmbedder):
        def encode(self, texts):
            calls.append(len(texts))
            return super().encode(texts)

    texts = spark.createDataFrame([("a", "one"), ("b", "two"), ("a", "one")], "key string, text string")
    cache = state.VectorCache(spark, f"file://{tmp_path}/vectors", "m")
    assert cache.vectors(texts, backends.HashEmbedder(8)).count() == 3
    assert cache.missing(texts).count() == 0
    more = texts.unionByName(spark.createDataFrame([("c", "three")], "key string, text string"))
    assert cache.missing(more).count() == 1 and cache.vectors(more, backends.HashEmbedder(8)).count() == 4
    assert state.VectorCache(spark, f"file://{tmp_path}/vectors", "other").missing(texts).count() == 2


def test_frozen_groups(spark, tmp_path):
    frozen = state.FrozenGroups(spark, f"file://{tmp_path}/frozen", keep=2)
    groups = spark.createDataFrame([(1, 0), (2, 1)], "clause_id long, cluster int")
    assert frozen.load("a") is None
    for name in ("a", "b", "c"):
        frozen.save(name, groups)
    assert frozen.load("c").count() == 2 and sum(frozen.load(n) is not None for n in "abc") == 2


def test_stream_scores_like_a_table(spark, done, tmp_path):
    from answerloom.functions.vectors import group_means
    from answerloom.streaming import score

    run, _, table = done
    embedder = backends.HashEmbedder()
    mean = np.array(group_means(run.vectors.select(F.lit(0).alias("k"), "vec"), "k", "vec").first()["mean"])
    answers = table.select("row_id", "text")
    fixed = lambda df: score.score_answers(df, run.themes["ALL"], embedder, mean)
    answers.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(answers.schema).parquet(f"{tmp_path}/in")
    q = score.start(stream, fixed, f"{tmp_path}/out", f"{tmp_path}/check", once=True)
    q.awaitTermination(120)
    got = {tuple(r)[:4] for r in spark.read.parquet(f"{tmp_path}/out").select("row_id", "clause", "theme_idx", "via").collect()}
    assert got == {tuple(r) for r in fixed(answers).select("row_id", "clause", "theme_idx", "via").collect()} and got


def test_command_line(spark, tmp_path, capsys):
    lines = ["question,text"] + [f'{q},"{t}"' for _, q, t in synthetic.survey(160)]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    (tmp_path / "c.json").write_text(json.dumps(SETTINGS))
    args = ["--config", f"{tmp_path}/c.json", "--input", f"file://{tmp_path}/s.csv", "--run-dir", f"{tmp_path}/run"]
    assert cli.main([*args, "--until", "themes"]) == 0
    assert cli.main([*args, "--edit", "drop Nobody"]) == 2 and "not a theme" in capsys.readouterr().out


def test_settings():
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    c = Config({"themes": {"n": 3, "curation": {"drop": ["x"]}}})
    assert c.signature() == Config({"themes": {"n": 3, "curation": {}}}).signature() != Config({"themes": {"n": 4}}).signature()
    assert c.get("themes.n") == 3 and c.get("themes.x.y", 7) == 7


def changed(section, **values):
    return Config(deep_merge(SETTINGS, {section: values}))


def test_answers_that_mean_nothing_are_not_valid(spark, done, tmp_path):
    run, _, table = done
    some = run.answers.where("valid").orderBy("row_id").first().text_clean
    out = pipeline.run(spark, table, changed("input", non_answer_examples=[some], non_answer_min_sim=0.999), str(tmp_path), "survey", until="ingest")
    gone = {r.row_id for r in run.answers.where("valid").collect()} - {r.row_id for r in out.answers.where("valid").collect()}
    assert gone == {r.row_id for r in run.answers.where(F.lower("text_clean") == some.lower()).collect()}
    assert out.answers.where("not valid and text_key <> ''").count() == 0 and out.answers.columns == run.answers.columns


def test_curation_seeds_and_additions(spark, done, tmp_path):
    run, folder, table = done
    name = next(t.name for t in run.themes["ALL"] if not t.general)
    config = changed("themes", curation={"seeds": {name: ["the colour of the box", "a red box"]}, "add": {"Box Colour": ["the colour of the box"]}})
    out = pipeline.run(spark, table, config, folder, "survey", until="themes")
    assert "Box Colour" in [t.name for t in out.themes["ALL"]]
    with pytest.raises(ValueError):
        pipeline.run(spark, table, changed("themes", curation={"seeds": {"Nobody": ["x"]}}), folder, "survey", until="themes")
    # the groups of the first run were kept, and both runs started from them
    from pathlib import Path

    assert len(list(Path(folder, "frozen").iterdir())) == 1


def model():
    class Model:
        """A scorer called in batches, as a neural model would be."""

        name = "model-1"

        def predict(self, texts, aspects=None):
            assert len(texts) <= backends.MODEL_BATCH and [len(t) for t in texts] == sorted(len(t) for t in texts)
            good, bad = ("love", "great", "easy", "good"), ("hate", "bad", "slow", "poor", "expensive")
            out = []
            for t in texts:
                p, n = (sum(w in t.lower() for w in ws) for ws in (good, bad))
                out.append([n / (p + n + 0.1), 0.1 / (p + n + 0.1), p / (p + n + 0.1)])
            return np.array(out)

    return Model()


def test_a_model_in_batches_and_learned_words(spark, done):
    run, folder, table = done
    out = pipeline.run(spark, table, Config(SETTINGS), folder, "survey", scorer=model())
    words = pipeline.learned_words(out, model(), 2)
    assert words and set(words.values()) <= {1, -1} and all(words.get(w, 1) == 1 for w in ("love", "great")) and all(words.get(w, -1) == -1 for w in ("slow", "hate"))
    assert out.result.count() == table.count() and {r.p_pos for r in out.overall.collect()} != {r.p_pos for r in run.overall.collect()}
    # opinion words near an aspect count first
    df = spark.createDataFrame([("the screen is great but after a long day of hard use the battery is bad", "Battery"), ("the screen is great", "Battery")], "t string, a string")
    near = backends.scored(df, backends.LexiconScorer(), "t", "a").collect()
    assert near[0].p_neg > near[0].p_pos and near[1].p_pos > near[1].p_neg


def test_topic_words_weigh_in(spark, done, tmp_path):
    _, _, table = done
    out = pipeline.run(spark, table, changed("themes", topic_weight=0.5, filler_mode="hybrid", sentiment_axis={"positive": ["good", "great"], "negative": ["bad", "poor"]}), str(tmp_path), "survey", until="themes")
    assert len(out.themes["ALL"]) >= 3


def test_streams_match_keywords(spark, done):
    from answerloom.functions.vectors import group_means
    from answerloom.operators import assign
    from answerloom.streaming import score

    run, _, table = done
    embedder, themes = backends.HashEmbedder(), run.themes["ALL"]
    mean = np.array(group_means(run.vectors.select(F.lit(0).alias("k"), "vec"), "k", "vec").first()["mean"])
    frame = assign.theme_frame(spark, themes)
    words = [[r.word for r in assign.matching_words(frame, assign.AssignRules()).where(F.col("theme_idx") == j).orderBy("position").collect()] for j in range(len(themes))]
    keywords = assign.Keywords(words, [None] * len(themes), assign.other_words(themes), [])
    via = [{r.via for r in score.score_answers(table.select("row_id", "text"), themes, embedder, mean, keywords=k).select("via").distinct().collect()} for k in (None, keywords)]
    assert not via[0] & {"both", "keyword"} and via[1] & {"both", "keyword"}


def test_json_through_the_file_system(spark, tmp_path):
    path = f"file://{tmp_path}/deep/er/x.json"
    assert state.load_json(path) is None and state.load_json(path, 3) == 3
    state.save_json(path, {"ä": [1, None]})
    state.save_json(path, {"ä": [2, None]})
    assert state.load_json(path) == {"ä": [2, None]}
    (tmp_path / "bad.json").write_text("{")
    assert state.load_json(f"{tmp_path}/bad.json") is None


def test_large_delimited_files_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ONE_TASK", 10)
    (tmp_path / "a.csv").write_text("q,text\n" + "x,hello\n" * 50)
    (tmp_path / "b.csv").write_text('q,text\nx,"one\ntwo"\n')
    assert tables.read_table(spark, f"file://{tmp_path}/a.csv").count() == 50
    assert [r.text for r in tables.read_table(spark, f"file://{tmp_path}/b.csv").collect()] == ["one\ntwo"]
    assert not tables.spans_lines(['a,"b"', "c"]) and tables.spans_lines(['a,"b', 'c"', ""])


def test_counts_are_tried_and_one_is_suggested(spark, done):
    _, folder, table = done
    seen = []
    rows, best = pipeline.suggest_count(spark, table, Config(SETTINGS), folder, "survey", [5, 6], lambda k, n, count: seen.append((k, n, count)))
    assert [r["asked"] for r in rows] == [5, 6] and best in (5, 6) and seen == [(1, 2, 5), (2, 2, 6)]
    assert all(0 <= r["unmatched"] <= 1 and r["themes"] <= r["asked"] + 1 for r in rows)


def test_a_dictionary_decides_what_is_misspelt(spark, tmp_path):
    (tmp_path / "words.txt").write_text("battery 900\nscreen 400\nthe\nis\ngood\n")
    rows = [(k, "q", "the battery is good") for k in range(5)] + [(7, "q", "the batery is good"), (8, "q", "the scren is good")]
    table = spark.createDataFrame(rows, "row_id long, question string, text string")
    base = {"question_col": "question", "text_col": "text", "spell_correct": True, "dictionary": f"file://{tmp_path}/words.txt"}
    out = {r.row_id: r.text_clean for r in pipeline.ingest_answers(table, Config({"input": base})).collect()}
    assert out[7] == "the battery is good" and out[8] == "the scren is good"
