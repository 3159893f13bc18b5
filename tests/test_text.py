"""Segmentation and words against a character scanner written from the rules, on rule tables and random texts."""

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkvane.functions import batch, text as tx
from inkvane.functions.wordlists import ABBREVIATIONS

CLOSERS = "\"'）)]”’»"


def scan(text):
    out, at = [], 0
    for m in [*re.finditer(r"\n[ \t]*\n+", text), None]:
        end = m.start() if m else len(text)
        start, i = at, at
        while i < end:
            if text[i] in ".!?":
                j = i
                while j < end and text[j] in ".!?":
                    j += 1
                run = text[i:j]
                while j < end and text[j] in CLOSERS:
                    j += 1
                w = re.search(r"[A-Za-z][A-Za-z']*\Z", text[:i])
                # the word is the longest run of letters and apostrophes, from its first letter
                k = i
                while k > 0 and re.match("[A-Za-z']", text[k - 1]):
                    k -= 1
                word = text[k:i].lstrip("'")
                short = run == "." and w and (len(word) == 1 or word.lower() in ABBREVIATIONS)
                if (j == end or text[j].isspace()) and not short:
                    out.append((start, j))
                    start = j
                i = j
            else:
                i += 1
        out.append((start, end))
        at = m.end() if m else end
    spans = []
    for a, b in out:
        s = text[a:b]
        if s.strip():
            a += len(s) - len(s.lstrip())
            spans.append((a, a + len(s.strip()), s.strip()))
    return spans


def ours(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = {r["i"]: [(s["start"], s["end"], s["text"]) for s in r["s"] or []] for r in df.select("i", tx.sentences(F.col("text")).alias("s")).collect()}
    return [rows[i] for i in range(len(texts))]


CASES = ["", "  \n ", "One. Two! Three?", "Dr. Smith met Mrs. Jones. They left.", "Pi is 3.14 and example.com works. Yes.", "He said \"Go!\" Then (maybe.) he went.", "Wait... what?! No.",
         "First line\nwrapped. Second.", "Head\n\nBody text. More\n \t\n\nEnd", "J. R. Smith vs. the o'clock. 'a. b", "End.  Next", "a\x1c b. c.\x1cd", "😀 ok. 😀", "n\xe9. A", "x.'''' y", "x. y"]


def test_rules(spark):
    assert ours(spark, CASES[:-1]) == [scan(t) for t in CASES[:-1]]


def test_null_and_private_marks(spark):
    assert ours(spark, [None]) == [[]]
    assert [s[2] for s in ours(spark, ["One. Two. Three"])[0]] == ["One.", "Two.", "Three"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="abZ .!?'\"\n\t)”é3Drmx\xa0\x1c😀", max_size=60), min_size=40, max_size=60))
def test_random(spark, texts):
    assert ours(spark, texts) == [scan(t) for t in texts]


def test_words(spark):
    texts = ["Don't stop at 1,234.5 or ٣٤ caf\xe9s", "a'b'c d' 12", ""]
    want = [[(m.group(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z]+(?:'[A-Za-z]+)*|\d+(?:[.,]\d+)*", t)] for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [[] for _ in texts]
    for r in tx.explode_words(df, "i").orderBy("i", "sid", "pos").collect():
        got[r["i"]].append((r["word"], r["start"], r["end"]))
    assert got == want


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abZ .!?'\"\n\t)”é3Drmx\xa0\x1c\ue000\ue001😀", max_size=80))
def test_batches_cut_as_the_scanner(t):
    assert [(a, b, t[a:b]) for a, b in batch.sentence_spans(t)] == [tuple(x)[-3:] for x in scan(t)]


def test_batches_cut_as_the_columns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["Mr", "dr.", "a", " ", ". ", "'", "''", "etc.", "\n\n", "?!", ")", "\x85", "St. "]) for _ in range(40)) for _ in range(300)] + ["'" * 20 + "a. B", "x" * 90 + ". Y", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", tx.sentences(F.col("text")).alias("a"), batch.sentences(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_a_text_of_a_megabyte():
    """Time grows with the length of a text, not with its square."""
    t = "Some words stand here, and more of them follow. " * 20000
    at = time.process_time()
    got = batch.text_features([t], ("sentence", "lexical", "repetition", "style"))
    assert time.process_time() - at < 20 and got["sent_count"][0] == 20000
