import random

import pytest
from pyspark.sql import functions as F

from inkvane.llm import sentences
from inkvane.llm.sentences import Model, Splitter

from tests.llm.conftest import record, sentence

MODEL = Model({"en": {"dr": 0.0, "e.g": 0.0, "p.m": 0.8, "vol": 0.0}, "de": {"z": 0.0, "b": 0.0}}, {"en": frozenset({"no", "vol"})}, {"de": frozenset({"mai"})}, {"en": frozenset({"the", "in"})}, {"en": frozenset({"the"}), "de": frozenset({"die"})})

CASES = [
    ("en", "Dr. Who met e.g. Bob at 3.14 km. He left!", ["Dr. Who met e.g. Bob at 3.14 km.", "He left!"]),
    ("en", "We closed at 4 p.m. Bob left at 5 p.m. with us.", ["We closed at 4 p.m.", "Bob left at 5 p.m. with us."]),
    ("en", "See No. 12 of vol. 3. No. He said no. The end.", ["See No. 12 of vol. 3.", "No. He said no.", "The end."]),
    ("en", "\"Where is it?\" asked Ann. (It was here.) Well... the man waited. So what?! Yes.", ["\"Where is it?\" asked Ann.", "(It was here.)", "Well... the man waited.", "So what?!", "Yes."]),
    ("en", "A heading\n\nOne line\nwrapped here.  Two words. “Quote ends.” Next.", ["A heading", "One line\nwrapped here.", "Two words.", "“Quote ends.”", "Next."]),
    ("en", "all in small letters. the dog ran? it did! dr. who ran.", ["all in small letters.", "the dog ran?", "it did!", "dr. who ran."]),
    ("en", "J. R. Smith came. It ran at example.com today.", ["J. R. Smith came.", "It ran at example.com today."]),
    ("de", "Am 3. Mai gilt z. B. für alle. „Wo ist er?“, fragte sie. „Hier.“ Gut.", ["Am 3. Mai gilt z. B. für alle.", "„Wo ist er?“, fragte sie.", "„Hier.“", "Gut."]),
    ("fr", "Il cria « Halte ! » et partit. « La pluie vint. » Bien ! Oui ?", ["Il cria « Halte ! » et partit.", "« La pluie vint. »", "Bien !", "Oui ?"]),
    ("zh", "他说：“别动！”然后走了。真的吗？！林峰……还是走了。“旧的。”（见图29。）1912年。", ["他说：“别动！”然后走了。", "真的吗？！", "林峰……还是走了。", "“旧的。”", "（见图29。）", "1912年。"]),
    ("ja", "「どこですか？」と聞いた。冬を越した？雨が降った！", ["「どこですか？」と聞いた。", "冬を越した？", "雨が降った！"]),
    ("ar", "«أين الجسر؟» سأل نور. قال د. نومان إن؟ نعم!", ["«أين الجسر؟» سأل نور.", "قال د. نومان إن؟", "نعم!"]),
    ("hi", "डॉ. नेतिक ने देखा? “रोटी कहाँ है?” राम ने पूछा। अच्छा।", ["डॉ. नेतिक ने देखा?", "“रोटी कहाँ है?” राम ने पूछा।", "अच्छा।"]),
    ("ru", "«Где же песня?» — спросил сосед. «Он ушёл.» Да.", ["«Где же песня?» — спросил сосед.", "«Он ушёл.»", "Да."]),
    ("th", "ฝนตกริมคลอง พ.ศ.2008มีเรือ\nสะพาน", ["ฝนตกริมคลอง", "พ.ศ.2008มีเรือ", "สะพาน"]),
    ("en", " \n\t ", []),
]


@pytest.mark.parametrize("lang,text,want", CASES)
def test_rules(lang, text, want):
    spans = Splitter(MODEL, lang).spans(text)
    assert [text[a:b] for a, b in spans] == want


def test_unseen_signs_keep_offsets():
    t = "One​ word.⁠ Two﻿ words."
    assert [t[a:b] for a, b in Splitter(MODEL, "en").spans(t)] == ["One​ word.⁠", "Two﻿ words."]


def test_learning_and_table(make):
    rng = random.Random(6)
    names = ["Xavira", "Yolben", "Zulmar", "Quorin", "Wexley", "Vandor"]
    rows = []
    for i in range(300):
        parts = [sentence(rng, 6) for _ in range(4)]
        parts[1] = f"We met Capt. {rng.choice(names)} near the {rng.choice(['mill', 'wall', 'gate'])}."
        parts[2] = f"See Nr. {rng.randint(1, 99)} and the lamp of the yard."
        rows.append(record(f"r{i}", " ".join(parts), lang="en" if i % 10 else None))
    rows += [record("null", None), record("blank", " \n "), record(None, "One. Two."), record("r0", rows[0][2]), record("long", "Go on. " * 20_000)]
    df = make(rows)
    m = sentences.learn(df)
    assert "capt" in m.abbreviations["en"] and "nr" in (set(m.abbreviations["en"]) | set(m.before_number["en"]))
    got = {}
    for r in sentences.split(df, model=m).collect():
        got.setdefault(r["id"], []).append((r["start_pos"], r["end_pos"]))
    text_of = {r[1]: r[2] for r in rows}
    assert "null" not in got and "blank" not in got and None not in got and len(got["long"]) == 20_000
    for i in (*range(0, 300, 7), 10):
        t = text_of[f"r{i}"]
        spans = sorted(got[f"r{i}"])
        assert len(spans) == 4 and all(t[a:b] == t[a:b].strip() and t[b - 1] == "." for a, b in spans)


def test_nothing(make):
    assert sentences.split(make([])).count() == 0
    assert sentences.split(make([record("a", "One. Two.", lang=None)])).count() == 2


def test_rare_types_of_a_large_corpus(spark):
    big = spark.range(60).select(F.repeat(F.lit("lo "), 100_000).alias("text"), F.lit("en").alias("lang"))
    few = [(f"It is approx. {w} wide. The rest is not.", "en") for w in ("ten", "two", "six", "five")]
    m = sentences.learn(big.unionByName(spark.createDataFrame(few, "text string, lang string")))
    assert "approx" in m.abbreviations["en"] and "wide" not in m.abbreviations["en"]
    with pytest.raises(KeyError):
        m.abbreviations["en"]["wide"]


def test_starters_and_words_after_numbers_by_ratio(spark):
    rng = random.Random(5)
    words = ["lamp", "mill", "wall", "gate", "yard", "door", "rain", "road"]
    rows = []
    for i in range(24_000):
        ws = [rng.choice(words) for _ in range(14)]
        if i % 2400 == 3:
            ws[0] = "hence"  # ten in 24,000 periods, and once inside a sentence
        elif i % 100 == 50 + i // 100 % 3:
            ws[0] = "Yolben"  # a name that starts sentences
        if i == 7:
            ws[4] = "hence"
        end = f" in {rng.randint(1000, 1999)}" if i % 3 == 0 else ""
        rows.append(ws[0].capitalize() + " " + " ".join(ws[1:]) + end + ".")
    texts = [" ".join(rows[i : i + 50]) for i in range(0, 24_000, 50)]
    texts += [f"The bill of {i}. Brumaire was paid." for i in range(1, 20)] + ["The bill of Brumaire was paid."] * 40
    m = sentences.learn(spark.createDataFrame([(x, "en") for x in texts], "text string, lang string"))
    assert "hence" in m.starters["en"] and not set(words) & set(m.starters["en"])
    assert set(m.after_number["en"]) == {"brumaire"}


@pytest.mark.parametrize("labelled", [True, False])
def test_learning_from_texts_without_a_language(make, labelled):
    names = ["Xavira", "Yolben", "Zulmar", "Quorin", "Wexley", "Vandor"]
    rows = [record(f"e{i}", "The mill is old. We saw the gate of the yard.", lang="en" if labelled else "") for i in range(20)]
    rows += [record(f"r{i}", f"We met Capt. {names[i % 6]} near the gate. The yard is old.", lang=None) for i in range(60)]
    df = make(rows)
    m = sentences.learn(df)
    assert list(m.abbreviations) == ["en" if labelled else sentences.POOL] and "capt" in next(iter(m.abbreviations.values()))
    assert {r["n"] for r in sentences.split(df, model=m).groupBy("id").agg(F.count("*").alias("n")).collect()} == {2}


def test_guess_reads_the_whole_text():
    frequent = {"en": frozenset({"the"}), "de": frozenset({"die"})}
    assert sentences.guess_language("the mill " * 2500 + "die wand " * 5000, frequent) == "de"
    assert sentences.guess_language("x " * 20_000, frequent) is None


def test_words_of_any_length_are_looked_at_whole():
    long = "q" * 500
    assert sentences._before(f"x {long}.", 0, 502) == long and sentences._before("a.b" * 100 + ".", 0, 300) == "a.b" * 100
    assert sentences._before(f"x {long}", 400, 502) == "q" * 102 and sentences._before("12,345.", 0, 6) == "12,345"
