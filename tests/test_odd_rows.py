"""Queries against their SQL on a few rows that the smallest tables do not have."""

import duckdb
import pytest

from answerloom.catalogue import QUERIES, SQL


def check_against_sql(spark, folder, name, rows):
    """Rows of the query over (conv_id, turn, role, text), which have to be those of its SQL."""
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = con.sql(SQL[name])
    got = [r.asDict() for r in QUERIES[name](spark, str(folder)).collect()]
    assert sorted(map(str, got)) == sorted(str({c: r[want.columns.index(c)] for c in got[0]}) for r in want.fetchall())
    return got


# a letter of another script stands right before or after the word that becomes "not"
BESIDE_ACCENTS = [(1, 0, "user", "écon une la"), (2, 0, "user", "conñ de un"), (3, 0, "user", "con é une"), (4, 0, "user", "con_ la"), (5, 0, "user", "con1 la der")]


def test_lexical_flags_beside_accents(spark, tmp_path):
    got = check_against_sql(spark, tmp_path, "lexical_flags", BESIDE_ACCENTS)
    assert {r["conv_id"]: (r["flip_pos"], r["flip_neg"]) for r in got} == {1: (False, True), 2: (True, False), 3: (False, True), 4: (False, False), 5: (False, False)}


def test_negation_scan_beside_accents(spark, tmp_path):
    got = check_against_sql(spark, tmp_path, "negation_scan", BESIDE_ACCENTS)
    assert {r["conv_id"]: r["negated"] for r in got} == {1: 2, 2: 2, 3: 1, 4: 0, 5: 0}


def test_firm_text_beside_accents(spark, tmp_path):
    got = check_against_sql(spark, tmp_path, "firm_text", [(1, 0, "user", "écon a bit of it"), (2, 0, "user", "con_ a bit of it")])
    assert {r["conv_id"]: r["firm"] for r in got} == {1: True, 2: False}


# lower case of "İ" is one letter in the SQL, "i", that does not part the words beside it
DOTTED = [(1, 0, "user", "con İbis la aİb DİE"), (2, 0, "user", "İ ΣaΣ und con K one")]


def test_negation_scan_of_dotted_capitals(spark, tmp_path):
    got = check_against_sql(spark, tmp_path, "negation_scan", DOTTED)
    assert {r["conv_id"]: (r["words"], r["negated"]) for r in got} == {1: (5, 3), 2: (6, 2)}


# rows that share a key, or have none, are one row in the SQL, which takes their tokens in turns
SHARED_KEYS = [(1, 0, "user", "con la de une la"), (1, 0, "user", "con la de une la"), (None, 0, "user", "con la"), (None, 0, "user", "con la"), (None, None, "user", "der la une die of"), (None, None, "user", None), (2, None, "user", "Con, la"), (2, 1, "user", "?"), (2, 1, "user", "")]


@pytest.mark.parametrize("name", ["negation_scan", "lexical_flags", "firm_text"])
def test_rows_that_share_a_key(spark, tmp_path, name):
    got = check_against_sql(spark, tmp_path, name, SHARED_KEYS)
    assert len(got) == 4
    if name == "negation_scan":
        assert {(r["conv_id"], r["turn"]): (r["words"], r["negated"]) for r in got} == {(1, 0): (10, 4), (None, 0): (4, 3), (None, None): (5, 0), (2, None): (2, 0)}


# each third word is negated wherever it stands
NEGATED = [(k, 0, "user", "tall or no small") for k in range(20)]


def test_valence_consistency_counts_negated_words(spark, tmp_path):
    got = check_against_sql(spark, tmp_path, "valence_consistency", NEGATED)
    assert {r["word"]: r["sign"] for r in got} == {"tall": 1, "small": -1}


def test_word_support_counts_negated_words(spark, tmp_path):
    got = check_against_sql(spark, tmp_path, "word_support", NEGATED)
    assert {r["word"]: r["n"] for r in got} == {"tall": 20, "small": 20}


# one key with two texts, in one role and in two; nulls in either part of a key; a capital that is one letter in lower case
ODD_KEYS = [(1, 0, "user", "tall small"), (1, 0, "user", "small wide"), (1, 0, "assistant", "tall"), (None, 1, "user", "tall"), (1, None, "user", "tall"), (1, 1, "user", "İtall tall"), (1, 1, None, "tall"), (-1, 1, "user", "wide"), (1, -1, "user", "wide"), (2, 2, "user", None)]


@pytest.mark.parametrize("name", ["word_support", "valence_consistency"])
def test_odd_keys_of_word_counts(spark, tmp_path, name):
    rows = [(*r[:3], r[3] and f"{r[3]} {r[3]}") for r in ODD_KEYS] + [(k, 0, "user", "tall, small, wide") for k in range(10, 30)]
    got = check_against_sql(spark, tmp_path, name, rows)
    if name == "word_support":
        assert {r["word"]: r["n"] for r in got} == {"tall": 25, "small": 21, "wide": 23}


def test_word_support_leaves_negated_words_out_by_itself(spark):
    from answerloom.operators import sentiment

    scored = spark.createDataFrame([(str(k), str(k), "tall or no small", 0.35, 0.33) for k in range(50)], "text_key string, clause_key string, clause string, p_pos double, p_neg double")
    questions = scored.selectExpr("text_key", "'q' AS question")
    got = {tuple(r) for n in (1, 7) for r in sentiment.word_support(scored.repartition(n), questions).selectExpr("word", "n", "means[0]").collect()}
    assert got == {("tall", 50, 0.35 - 0.33)}


def test_word_groups_embed_each_text_once(spark, monkeypatch):
    from answerloom.operators import backends

    from test_queries import SF

    if not SF.is_dir():
        pytest.skip("the test tables are not here")
    encoded = spark.sparkContext.accumulator(0)

    class Counting(backends.HashEmbedder):
        def encode(self, texts):
            encoded.add(len(texts))
            return super().encode(texts)

    monkeypatch.setattr(backends, "HashEmbedder", Counting)
    assert len(QUERIES["word_groups"](spark, str(SF)).collect()) > 1
    assert encoded.value == spark.read.parquet(f"{SF}/conversations.parquet").where("text is not null").count()


def test_hash_vectors_are_those_of_the_plain_formula(monkeypatch):
    import re
    import zlib

    import numpy as np

    from answerloom.operators import backends

    monkeypatch.setattr(backends, "WORD_BYTES", 0)  # 1,024 words are remembered
    texts = ["", "Été à la mer, été", "a a b_1 don't", " ".join(f"w{k % 1500}" for k in range(4000)), "x" * 3000, "w1 w2"]
    want = np.zeros((len(texts), 16))
    for row, text in zip(want, texts):
        words = re.findall(r"\w+", text.lower())
        for f in [*(f"w:{w}" for w in words), *(f"{n}:{p[i : i + n]}" for w in words for n in (3, 4) for p in [f"<{w}>"] for i in range(len(p) - n + 1))]:
            h = zlib.crc32(f.encode())
            row[h % 16] += 1.0 if h >> 20 & 1 else -1.0
    want = (want / (np.linalg.norm(want, axis=1, keepdims=True) + 1e-12)).astype(np.float32)
    embedder = backends.HashEmbedder(16)
    for _ in range(2):
        assert (embedder.encode(texts) == want).all()


def test_member_means(spark):
    from answerloom.functions.vectors import member_means

    rows = [(["a", "b"], [1.0, 2.0]), (["b", "x"], [3.0, 4.0]), ([], [9.0, 9.0]), (None, [9.0, 9.0]), (["a"], None)]
    df = spark.createDataFrame(rows, "keys array<string>, vec array<float>")
    for n in (1, 3):
        got = {r.key: (r.n, r["mean"]) for r in member_means(df.repartition(n), "keys", "vec", ["a", "b", "c"]).collect()}
        assert got == {"a": (1, [1.0, 2.0]), "b": (2, [2.0, 3.0])}
    assert member_means(df.limit(0), "keys", "vec", ["a"]).count() == 0
