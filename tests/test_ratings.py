"""Ratings, polarity, quality figures and suggestions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.operators import clustering, evaluation, quality, rating, sentiment, suggest
from answerloom.operators.sentiment import RatingRules
from answerloom.plans import curation
from answerloom.operators.assign import Theme


def codes(spark, rows, rules, valence=None):
    df = spark.createDataFrame([("t", "ALL", k, c, p, n, 0.0) for k, (c, p, n) in enumerate(rows)], "text_key string, scope string, theme_idx int, clause string, p_pos double, p_neg double, p_neu double")
    return {r.theme_idx: r for r in sentiment.aggregate_ratings(df, rules, valence).collect()}


def test_decide_and_mixed_policy(spark):
    for policy, want in (("stronger", 1), ("negative", 2), ("neutral", 0)):
        got = codes(spark, [("a", 0.92, 0.90), ("b", 0.2, 0.1), ("c", 0.1, 0.9)], RatingRules(mixed_policy=policy))
        assert [got[k].code for k in range(3)] == [want, 0, 2] and [got[k].mixed for k in range(3)] == [1, 0, 0]


def test_negated_words_correct_the_model(spark):
    valence = {"artificial": -1, "good": 1, "awful": -1}
    rows = [("not so artificial", 0.1, 0.9), ("not good", 0.9, 0.1), ("awful not artificial", 0.1, 0.9), ("good", 0.9, 0.1)]
    got = codes(spark, rows, RatingRules(), valence)
    assert [got[k].code for k in range(4)] == [1, 2, 2, 1] and [got[k].lex_fix for k in range(4)] == [True, True, False, False]
    got = codes(spark, rows, RatingRules(spec=True), valence)
    assert got[0].code == 2 and not got[0].lex_fix


@pytest.mark.parametrize(("pos", "neg", "neu", "name", "want"), [(18, 1, 0, "q", 1), (1, 18, 0, "q", 2), (10, 8, 0, "q", None), (3, 0, 0, "q", None), (10, 8, 0, "What did you NOT LIKE", 2), (10, 8, 0, "What do you like", 1), (3, 0, 30, "Dislikes", 2)])
def test_polarity(spark, pos, neg, neu, name, want):
    rows = [(name, 1)] * pos + [(name, 2)] * neg + [(name, 0)] * neu
    assert rating.infer_polarity(spark.createDataFrame(rows, "question string, code int")).first().polarity == want


def test_theme_rating_in_a_praise_question(spark):
    rules, praise = RatingRules(), rating.Polarity(1, "short", themes_follow_question=True)
    rows = [(2, False, False, False, False), (2, True, False, False, False), (0, False, False, False, False), (None, True, True, True, True), (1, False, True, False, False), (0, False, False, True, False), (2, True, False, False, True)]
    df = spark.createDataFrame(rows, "code int, ev_neg boolean, firm_neg boolean, complaint boolean, luke boolean")
    flags = {"ev_pos": F.lit(False), "ev_neg": F.col("ev_neg"), "firm_neg": F.col("firm_neg"), "complaint": F.col("complaint")}
    out = df.select(rating.theme_rating(F.col("code"), F.lit(0.0), F.lit(0.9), flags, F.col("luke"), praise, rules).alias("c")).collect()
    assert [r.c for r in out] == [1, 2, 1, None, 2, 2, 0]


def test_overall_rating(spark):
    rules = RatingRules(neutral_phrases=(r"\bokay\b",))
    praise = rating.Polarity(1, "short", short_words=2)
    rows = [(0, "taste", True), (0, "a long neutral remark", True), (2, "bad", True), (1, "okay", True), (None, "n/a", False), (None, "", False)]
    df = spark.createDataFrame(rows, "code int, t string, valid boolean")
    out = df.select(rating.overall_rating(F.col("code"), F.col("t"), F.col("valid"), F.lit(0.0), F.lit(0.0), praise, rules).alias("c")).collect()
    assert [r.c for r in out] == [1, 0, 2, 0, 0, None]


def test_result_table(spark):
    rated = spark.createDataFrame([(1, "A", 1), (2, "B", 2)], "row_id long, column_name string, code int")
    wide = rating.wide_result(rated, ["A", "B", "General"]).withColumns({"answer": F.lit("x"), "overall": F.lit(2), "valid": F.lit(True)})
    wide = wide.unionByName(spark.createDataFrame([(3, "x", None, True)], "row_id long, answer string, overall int, valid boolean"), allowMissingColumns=True)
    out = rating.with_labels(rating.fill_general(wide, ["A", "B", "General"], "General", "answer", "overall", "valid", RatingRules()), ["A", "B", "General"], RatingRules())
    assert {r.row_id: (r.A, r.B, r.General) for r in out.collect()} == {1: ("Positive", None, None), 2: (None, "Negative", None), 3: (None, None, "Neutral")}


def test_coherence_and_gini(spark):
    docs = spark.createDataFrame([(1, "red blue"), (2, "red blue"), (3, "green"), (4, "none")], "doc_id long, text string")
    assert quality.npmi(docs, ["red", "blue"]).first()[0] == pytest.approx(1.0)
    assert quality.npmi(docs, ["red", "green"]).first()[0] == -1.0
    assert quality.npmi(docs, ["red", "nowhere"]).first()[0] is None
    assert quality.gini_of([4, 4, 4]) == 0.0 and quality.gini_of([9]) == 0.0
    sizes = spark.createDataFrame([(1,), (5,), (9,)], "size int")
    assert quality.gini(sizes).first()[0] == pytest.approx(quality.gini_of([1, 5, 9]))


def test_scope_report(spark):
    texts = ["price is high", "the price", "price again", "bad cost", "taste good", "the taste", "taste", "smell", "fine", "other"]
    clauses = spark.createDataFrame([(k, f"t{k}", t) for k, t in enumerate(texts)], "clause_id long, text_key string, clause string")
    pairs = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (7, 2), (8, 2), (7, 1)]
    assigned = spark.createDataFrame(pairs, "clause_id long, theme_idx int")
    themes = [Theme("Price", np.array([1.0, 0]), ("price", "cost")), Theme("Taste", np.array([0, 1.0]), ("taste",)), Theme("Smell", np.array([0.6, 0.8]), ("smell",))]
    r = quality.scope_report(clauses, assigned, themes)
    assert [t["size"] for t in r["themes"]] == [4, 4, 2] and [t["name_coverage"] for t in r["themes"]] == [0.75, 0.75, 0.5]
    assert r["summary"]["largest_share"] == 0.4 and r["summary"]["unassigned_share"] == pytest.approx(0.1)
    assert r["themes"][2]["nearest_theme"] == "Taste"


METRICS = [  # asked, mixed, weak, below, near, smallest, coherence, coverage, not_specific, unmatched, smallest_share
    (4, 0, 0, 0, 0, 60, -0.05, 0.60, 0.10, 0.02, 0.20),
    (6, 0, 0, 0, 0, 40, -0.10, 0.58, 0.08, 0.02, 0.09),
    (8, 0, 0, 0, 0, 25, -0.12, 0.57, 0.07, 0.02, 0.06),
    (9, 0, 0, 0, 0, 20, -0.13, 0.56, 0.06, 0.02, 0.05),
    (10, 1, 0, 0, 0, 15, -0.10, 0.60, 0.06, 0.02, 0.04),
    (12, 0, 2, 1, 1, 8, -0.20, 0.50, 0.05, 0.02, 0.02),
]
NAMES = "asked int, mixed int, weak_names int, below_bar int, near_duplicates int, smallest_theme int, coherence double, name_coverage_mean double, not_specific double, unmatched double, smallest_share double"


def test_recommended_count(spark):
    assert suggest.recommend(spark.createDataFrame(METRICS, NAMES)).first().asked == 9
    worse = [(m[0], m[1] + 1, *m[2:]) for m in METRICS]
    assert suggest.recommend(spark.createDataFrame(worse, NAMES)).first().problems == 1
    assert suggest.recommend(spark.createDataFrame([], NAMES)).isEmpty()
    assert suggest.default_range(100) == (4, 5) and suggest.default_range(10_000) == (4, 16)


def test_mmr_and_phrases():
    v = np.array([[1.0, 0], [0.99, 0.14], [0, 1.0]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert clustering.mmr(np.array([1.0, 0.9, 0.5]), v, 3, 1.0) == [0, 1, 2]
    assert clustering.mmr(np.array([1.0, 0.7, 0.5]), v, 2, 0.6) == [0, 2]
    assert clustering.distinct_phrases(["white pieces", "piece", "sweet", "sweetness", "label"]) == [0, 2, 4]


def test_linkages_find_groups():
    rng = np.random.default_rng(0)
    x = np.vstack([c + 0.05 * rng.normal(size=(20, 3)) for c in np.eye(3)])
    for linkage in ("average", "ward"):
        lab = clustering.cut(x, 3, linkage)
        assert [len(set(lab[k * 20 : k * 20 + 20])) for k in range(3)] == [1, 1, 1] and len(set(lab)) == 3
        assert (clustering.cut(x, 3, linkage) == lab).all()
    assert clustering.silhouette(x, np.repeat([0, 1, 2], 20)) > 0.8
    assert clustering.components(np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1]], bool)) == [0, 0, 2]


def themes():
    return [Theme(n, v, (n.lower(),), extra={"frequency": f}) for n, v, f in (("Bottle", np.array([1.0, 0]), 3), ("Easy", np.array([0, 1.0]), 1), ("Price", np.array([0.6, 0.8]), 2))]


def test_curation():
    out = curation.curate(themes(), {"ops": [["merge", "Opening", ["easy", "BOTTLE"]], ["rename", "Price", "Cost"]]})
    assert [t.name for t in out] == ["Opening", "Cost"] and len(out[0].sub_centres) == 2 and out[1].matched_by == "Price"
    warned = []
    out = curation.curate(themes(), {"drop": ["Nobody"], "rename": {"Easy": "Price"}, "extra_keywords": {"Price": ["cost"]}}, warn=warned.append)
    assert len(warned) == 2 and out[2].curated_keywords == ("cost",)
    for ops in ([["drop", "Nobody"]], [["rename", "Easy", "Price"]], [["merge", None, ["Easy", "Easy"]]], [["drop", "Easy"], ["drop", "Price"]]):
        with pytest.raises(ValueError):
            curation.curate(themes(), {"ops": ops})


def test_commands():
    edits, names = curation.Edits(), ["Easy", "Bottle", "Price"]
    for line in ("n 8", "add Colour: red, blue", "merge Easy + Bottle = Opening", "rename price = Cost", "remove Easy"):
        edits = curation.edited(line, edits, names)
    assert edits.n_themes == 8 and edits.required == ({"name": "Colour", "keywords": ["red", "blue"]},)
    assert edits.ops == (("merge", "Opening", ["Easy", "Bottle"]), ("rename", "Price", "Cost"), ("drop", "Easy"))
    assert curation.Edits.load(json.loads(json.dumps(edits.record()))) == edits
    for line in ("n 1", "n many", "add", "add :", "remove Nobody", "remove ,", "merge Easy", "merge Easy + Nobody", "rename Easy", "rename Nobody = X", "what", ""):
        with pytest.raises(curation.EditError):
            curation.edited(line, edits, names)
    assert curation.edited("Remove colour, Price", edits, names).required == ()
    assert curation.edited("add colour", edits, names).required == ({"name": "colour"},)
    assert curation.edited("reset", edits, names) == curation.Edits()
    assert curation.parse_required("Price: cost, value\n\nTaste") == [{"name": "Price", "keywords": ["cost", "value"]}, {"name": "Taste"}]
    assert curation.overrides(edits, {"ops": [["drop", "x"]]})["themes"]["curation"]["ops"][0] == ["drop", "x"]


def test_protected_names():
    said = curation.protected_names([{"name": "A"}], {"merge": {"B": ["C", "d"]}, "extra_keywords": {"E": ["word"]}, "seeds": {"F": ["x"]}, "ops": [["rename", "G", "H"], ["merge", None, ["I", "J"]]]})
    assert said == set("abcdefghij")


def test_evaluation(spark):
    found = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "item long, theme string")
    coded = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, "z")], "item long, coder_theme string")
    assert evaluation.theme_f1(found, coded).first().f1 == pytest.approx((1.0 * 2 + 2 / 3 * 2 + 0) / 5)
    assert evaluation.coder_groups(["Taste (+)", "Taste (-)", "Price (1)"]) == {"Taste": ["Taste (+)", "Taste (-)"], "Price": ["Price (1)"]}


def test_bisections(spark):
    from answerloom.operators import discover

    rng = np.random.default_rng(3)
    rows = [(k, 0, ([1.0, 0.0, 0.2] if k % 3 else [0.0, 1.0, 0.1]) + 0.05 * rng.normal(size=3)) for k in range(60)]
    df = spark.createDataFrame([(k, g, v.tolist()) for k, g, v in rows], "clause_id long, cluster int, vec array<double>")
    for limit in (1000, 10):  # ward linkage, and bisecting k-means over all rows
        out, score = discover.bisect(df, 0, discover.DiscoverRules(ward_limit=limit), 1)
        found = {r.clause_id: r.cluster for r in out.collect()}
        assert found == {k: 0 if k % 3 else 1 for k in range(60)}
        x, lab = np.array([v for *_, v in rows]), np.array([found[k] for k, *_ in rows])
        assert score == pytest.approx(clustering.silhouette(x, lab))
    assert discover.group_silhouette(df) == -1.0
