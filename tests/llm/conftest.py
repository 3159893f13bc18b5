"""Small made-up tables."""

import random

import pytest

RECORDS = "row_no long, id string, text string, label string, source string, group_id string, generation struct<model_family:string>, transform struct<kind:string,parent_id:string>, split string, lang string, loaded_at timestamp, class long, doc string, pair string, node string, side string, form string"


def record(i, text, split=None, group=None, parent=None, label="human", source="s", family=None, lang="en"):
    return (hash(i) % 10**9, i, text, label, source, group, (family,) if family else None, ("edit", parent) if parent else None, split, lang, None, 5, "clash", "clash", "clash", "clash", "clash")


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, RECORDS)


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


WORDS = ["".join(random.Random(k).choice("bcdfglmnprst") + random.Random(k + 7919).choice("aeiou") for k in range(j, j + 3)) for j in range(0, 1800, 3)]


def text(rng, n=6):
    return " ".join(sentence(rng) for _ in range(n))
