"""Every query with SQL against DuckDB on the smallest tables, and the plain behaviour of the others."""

import math
from pathlib import Path

import numpy as np
import pytest

from answerloom.catalogue import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    a = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    b = sorted(str(tuple(plain(r[k]) for k in order)) for r in want.fetchall())
    assert a == b


# -- queries without SQL, against plain versions --------------------------


def vectors():
    import pandas as pd

    e = pd.read_parquet(SF / "embeddings.parquet").dropna(subset=["embedding", "label"]).sort_values("vec_id")
    return np.array(e["embedding"].tolist(), float), e["label"].to_numpy(int)


def centres():
    x, label = vectors()
    m = np.array([x[label == g].mean(0) for g in sorted(set(label))])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def joined(x: np.ndarray, k: int, linkage: str) -> list[set[int]]:
    """Groups by joining the two nearest again and again, distances taken from the members."""
    groups = [{i} for i in range(len(x))]
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = x[sorted(groups[i])], x[sorted(groups[j])]
                if linkage == "average":
                    d = float(np.mean(1 - a @ b.T))
                else:
                    d = len(a) * len(b) / (len(a) + len(b)) * float(((a.mean(0) - b.mean(0)) ** 2).sum())
                if best is None or d < best[0]:
                    best = (d, i, j)
        _, i, j = best
        groups[i] |= groups.pop(j)
    return groups


def ward_halves(x: np.ndarray) -> list[int]:
    """Sizes of the two groups that ward linkage ends with, by the update of sums and sizes."""
    n, sums = np.ones(len(x)), x.copy()
    alive = list(range(len(x)))
    while len(alive) > 2:
        m, k = sums[alive] / n[alive][:, None], n[alive]
        sq = (m**2).sum(1)
        d = (sq[:, None] + sq[None, :] - 2 * m @ m.T) * (k[:, None] * k[None, :]) / (k[:, None] + k[None, :])
        d[np.tril_indices(len(alive))] = np.inf
        i, j = np.unravel_index(d.argmin(), d.shape)
        a, b = alive[i], alive[j]
        sums[a], n[a] = sums[a] + sums[b], n[a] + n[b]
        alive.remove(b)
    return sorted(int(n[a]) for a in alive)


def run(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, str(SF)).collect()]


def test_group_words_linkage(spark):
    found: dict = {}
    for j, g in run(spark, "group_words_linkage"):
        found.setdefault(g, set()).add(j)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, joined(centres(), 3, "average")))


def test_mmr_phrases(spark):
    v = centres()
    r = v @ v[0]
    r = (r - r.min()) / (r.max() - r.min() + 1e-12)
    chosen: list[int] = []
    while len(chosen) < 6:
        score = {j: round(0.6 * r[j] - 0.4 * max([v[j] @ v[c] for c in chosen], default=0.0), 12) for j in range(len(v)) if j not in chosen}
        chosen.append(max(score, key=lambda j: (score[j], -j)))
    assert [j for _, j in sorted(run(spark, "mmr_phrases"))] == chosen


def test_ward_bisect(spark):
    assert sorted(n for _, n in run(spark, "ward_bisect")) == ward_halves(vectors()[0])


def test_split_to_count(spark):
    rows = run(spark, "split_to_count")
    halves = ward_halves(vectors()[0])
    # the smaller half is left whole until it is the largest; every clause is in one of four groups
    assert len(rows) == 4 and sum(n for _, n in rows) == sum(halves) and max(n for _, n in rows) <= max(halves)


def test_complaint_phrases_lookbehind(spark):
    import re

    import pandas as pd

    c = pd.read_parquet(SF / "conversations.parquet")
    pattern = re.compile(r"(?<!not )(?<!n't )(?<!no )\bthe\s+\w+", re.I | re.A)
    want = {(r.conv_id, r.turn, bool(r.text and pattern.search(r.text))) for r in c.itertuples()}
    assert set(run(spark, "complaint_phrases_lookbehind")) == want


def test_dense_groups_are_the_labels(spark):
    n = len(vectors()[1])
    rows = run(spark, "dense_groups")
    assert 2 <= len(rows) <= 6 and sum(k for _, k in rows) <= n


def test_word_groups_votes(spark):
    """Each clause votes for the group of most of its topic words; here all in plain Python from the operator's own word groups."""
    from pyspark.sql import functions as F

    from answerloom.operators import discover

    words, labels, df = ["price", "cost", "taste", "smell"], [0, 0, 1, 1], {"price": 9, "cost": 3, "taste": 50, "smell": 4}
    texts = ["The price and the taste", "cost", "smells and tastes", "nothing at all", "price price taste"]
    c = spark.createDataFrame(list(enumerate(texts)), "clause_id long, clause string")
    got = {r.clause_id: r.cluster for r in discover.vote(c, words, labels, df, discover.DiscoverRules()).collect()}
    want = {}
    for k, t in enumerate(texts):
        own = {w.rstrip("s") for w in t.lower().split()} & set(words)
        votes = {g: sum(1 / math.log(2 + df[w]) for w in own if labels[words.index(w)] == g) for g in (0, 1)}
        if max(votes.values()) > 0:
            want[k] = max(votes, key=lambda g: (votes[g], -g))
    assert got == want
    assert QUERIES["word_groups"](spark, str(SF)).agg(F.sum("clauses")).first()[0] > 0


def test_all_queries_without_sql_are_compared():
    assert set(QUERIES) - set(SQL) == {"group_words_linkage", "mmr_phrases", "ward_bisect", "split_to_count", "complaint_phrases_lookbehind", "dense_groups", "word_groups"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
