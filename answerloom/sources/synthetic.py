"""A seeded survey of short answers about an app, for tests and demos."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

TOPICS = {
    "battery": ("the battery drains fast", "battery life is great", "battery usage is terrible"),
    "login": ("login fails with my password", "the login screen is easy", "login takes too long"),
    "search": ("search results are useless", "search finds everything quickly", "the search filter is broken"),
    "price": ("the price is too high", "price is fair for the value", "subscription price is expensive"),
    "design": ("the design looks clean", "screen design is ugly", "love the colour design"),
    "support": ("support never answers", "support staff is friendly", "customer support is slow"),
}
GENERIC = ("it is good", "i like it", "not for me", "nothing", "n/a", "no complaints")


def survey(n: int = 300, seed: int = 7) -> list[tuple[int, str, str]]:
    """(row_id, question, text); about one answer in eight is generic and one in three names two topics."""
    rng, rows, names = random.Random(seed), [], sorted(TOPICS)
    for k in range(n):
        draw = rng.random()
        if draw < 0.12:
            text = rng.choice(GENERIC)
        else:
            text = rng.choice(TOPICS[rng.choice(names)])
            if draw > 0.68:
                text += ", but " + rng.choice(TOPICS[rng.choice(names)])
        rows.append((k, "Like" if k % 2 == 0 else "Dislike", text))
    return rows


def survey_table(spark: SparkSession, n: int = 300, seed: int = 7) -> DataFrame:
    return spark.createDataFrame(survey(n, seed), "row_id long, question string, text string")
