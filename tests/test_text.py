"""Text expressions, on cases that are small enough to see."""

import pytest
from pyspark.sql import functions as F

from answerloom.functions import text as X
from answerloom.operators import ingest, segment, spelling
from answerloom.operators.segment import SegmentRules


@pytest.fixture(scope="module")
def value(spark):
    def of(expr, **columns):
        df = spark.createDataFrame([tuple(columns.values()) or (1,)], list(columns) or ["x"])
        return df.select(expr.alias("v")).first().v

    return of


def clauses(value, text, rules=SegmentRules()):
    return value(X.clauses("t", rules.contrast_words, rules.min_words, rules.keep_short, rules.short_not_opinion, rules.and_words), t=text)


def test_clauses_turn_at_contrast_words(value):
    assert clauses(value, "The taste is nice, but the smell is bad.") == ["The taste is nice", "the smell is bad"]
    assert clauses(value, "Good!") == ["Good!"]
    assert clauses(value, "It works well. The price is high!") == ["It works well", "The price is high"]


def test_one_word_beside_a_contrast_word(value):
    assert clauses(value, "No smell, but delicious") == ["No smell", "delicious"]
    assert clauses(value, "No smell, but delicious", SegmentRules(keep_short=False)) == ["No smell"]
    assert clauses(value, "No smell but also") == ["No smell"]


def test_cut_at_and(value):
    rules = SegmentRules(and_words=4)
    assert clauses(value, "it stays crispy in milk and the two chocolates go together", rules) == ["it stays crispy in milk", "the two chocolates go together"]
    assert clauses(value, "crispy in milk and sweet", rules) == ["crispy in milk and sweet"]


def test_cleaning(value):
    assert value(X.clean("t"), t="  don�t \n\t worry  ") == "don't worry"
    assert value(X.clean(F.lit(None).cast("string"))) == ""
    assert value(X.is_answer("t", 2, "n/?a|none"), t="N/A") is False
    assert value(X.is_answer("t", 2, "n/?a|none"), t="none of it") is True
    assert value(X.short_sha("t"), t="abc") == "a9993e364706816a"


NEGATION = [
    ("not so artificial", {"artificial"}),
    ("it wasn't as artificial as others", {"as", "artificial"}),
    ("not sweet, awful smell", {"sweet"}),
    ("less refreshing", {"refreshing"}),
    ("it lacks flavour", {"flavour"}),
    ("no doubt good", {"good"} - {"good"}),
    ("not only good", {"good"} - {"good"}),
    ("not good and artificial", {"good"}),
]


@pytest.mark.parametrize(("text", "negated"), NEGATION)
def test_negation(value, text, negated):
    found = {s.word for s in value(X.scan("t"), t=text) if s.negated}
    assert negated <= found
    assert not ({"good", "artificial", "awful", "smell"} - negated) & found or text == "not so artificial"


def test_flags_and_valence(value):
    known = X.valence_map({"good": 1, "artificial": -1})
    flags = value(X.lexical_flags("t", known), t="not so artificial and good")
    assert (flags.plain_pos, flags.plain_neg, flags.flip_pos, flags.flip_neg) == (True, False, True, False)
    assert value(X.word_valence(F.lit("artificiality"), known)) == -1
    assert value(X.word_valence(F.lit("goodness"), known)) == 1
    assert value(X.word_valence(F.lit("table"), known)) == 0


@pytest.mark.parametrize(("text", "firm"), [("Its taste", False), ("It tastes a bit sweet", False), ("It tastes a bit too sweet", True), ("The taste is rather unpleasant", True), ("it isn't what I expected", True)])
def test_firm(value, text, firm):
    assert value(X.is_firm("t"), t=text) is firm


def test_lukewarm(value):
    known = X.valence_map({"awful": -1})
    args = ([r"\bok(?:ay)?\b", r"\bnothing special\b"], known, [r"\btoo\b"])
    assert value(X.lukewarm("t", *args), t="it is okay") is True
    assert value(X.lukewarm("t", *args), t="okay but awful smell") is False
    assert value(X.lukewarm("t", *args), t="okay but too sweet") is False
    assert value(X.lukewarm("t", *args), t="lovely") is False


def test_patterns(value):
    assert value(F.rlike("t", F.lit(X.keyword_pattern(["flavor"], plural=True))), t="many Flavors here") is True
    assert value(F.rlike("t", F.lit(X.keyword_pattern(["flavor"]))), t="many Flavors here") is False
    assert value(F.rlike("t", F.lit(X.stem_pattern("pieces"))), t="one piece") is True
    assert value(F.rlike("t", F.lit(X.beside_pattern("milk", ["chocolate"]))), t="milk chocolate") is True
    assert value(F.rlike("t", F.lit(X.keyword_pattern(["re:pa.k"]))), t="PACK") is True


def test_case_and_twins(value):
    assert [value(X.like_case(F.lit(a), F.lit("color"))) for a in ("COLOUR", "Colour", "colour")] == ["COLOR", "Color", "color"]
    assert "realize" in value(X.spelling_twins(F.lit("realise"))) and "color" in value(X.spelling_twins(F.lit("colour")))


def test_corrections(spark):
    texts = ["the artificial taste"] * 6 + ["an artifical taste", "I dont like it. Artifical things", "we met Steaap there", "fizzy fizzy fizzy"]
    df = spark.createDataFrame([(t,) for t in texts], "text_clean string")
    fixes = {r.word: r.correction for r in spelling.corrections(df).collect()}
    assert fixes == {"artifical": "artificial", "dont": "don't"}
    assert spelling.corrections(df, protect=["artifical"]).where("word = 'artifical'").isEmpty()
    out = df.select(spelling.apply_corrections("text_clean", fixes).alias("t")).collect()
    assert out[6].t == "an artificial taste" and out[7].t == "I don't like it. Artificial things"


def test_layouts(spark):
    wide = spark.createDataFrame([(k, "m" if k % 2 else "f", f"I like the number {k} taste of it") for k in range(40)], "id long, gender string, likes string")
    assert ingest.text_columns(wide) == ["likes"] and ingest.detect_layout(wide).kind == "wide"
    long = spark.createDataFrame([("Like" if k % 2 else "Dislike", f"I like the number {k} taste of it") for k in range(60)], "Source string, Text string")
    found = ingest.detect_layout(long)
    assert (found.kind, found.question_col, found.text_col) == ("long", "Source", "Text")
    noisy = wide.withColumns({"pairs": F.concat(F.lit('{"a b c d": '), "id", F.lit("}")), "other": F.when(F.col("id") < 2, "a few words that are rare")})
    assert ingest.text_columns(noisy) == ["likes"]


def test_header_rows():
    rows = [["Survey 12", None, None], ["Section", "Section", None], ["What did you like", "What else", "Age"], ["q-1", "q-2", "q_3"], ["it is nice", "no", "12"]]
    assert ingest.guess_header_row(rows) == 2
    assert ingest.guess_header_row([["name", "text"], ["a", "b"]]) == 0
    assert ingest.guess_header_row([]) == 0


def test_id_rows(spark):
    df = spark.createDataFrame([(0, "q-id-6abb12345-value"), (1, "nice taste"), (2, None)], "row_id long, likes string")
    assert [r.row_id for r in ingest.drop_id_row(df, ["likes"]).orderBy("row_id").collect()] == [1, 2]
    assert ingest.drop_id_row(df.where("row_id > 0"), ["likes"]).count() == 2


def test_answers(spark):
    wide = spark.createDataFrame([(0, "Good taste", None), (1, "good taste", "N/A"), (2, "", "bad smell")], "row_id long, likes string, dislikes string")
    marked = ingest.mark_valid(ingest.unpivot_answers(wide, ["likes", "dislikes"]), 2, "n/?a")
    rows = {(r.row_id, r.question): r for r in marked.collect()}
    assert len(rows) == 6 and not rows[1, "dislikes"].valid and not rows[2, "likes"].valid and rows[2, "dislikes"].valid
    assert rows[0, "likes"].text_key == rows[1, "likes"].text_key != "" and rows[1, "dislikes"].text_key == ""
    unique = {r.text_key: r.text_clean for r in ingest.unique_texts(marked).collect()}
    assert unique[rows[0, "likes"].text_key] == "Good taste" and len(unique) == 2


def test_row_ids(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = {r.k: r.row_id for r in ingest.with_row_ids(df, ["k"]).collect()}
    assert got == {k: k for k in range(1000)}
    assert ingest.with_row_ids(df.limit(0), ["k"]).count() == 0


def test_clause_ids_do_not_depend_on_order(spark):
    df = spark.createDataFrame([("a", "one two but three four"), ("b", "one two")], "text_key string, text_clean string")
    one = {tuple(r) for r in segment.cut_clauses(df).collect()}
    two = {tuple(r) for r in segment.cut_clauses(df.repartition(3).orderBy(F.desc("text_key"))).collect()}
    assert one == two and len(one) == 3


def test_short_names():
    names = ingest.short_names(["What did you LIKE about the new product", "What did you NOT LIKE about the new product", "Age"])
    assert names["Age"] == "Age" and names["What did you LIKE about the new product"] == "LIKE" and names["What did you NOT LIKE about the new product"] == "NOT LIKE"
