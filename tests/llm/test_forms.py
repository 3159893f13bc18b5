import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkvane.llm import codepoints as cp
from inkvane.llm import forms, textform

from tests.llm.conftest import record

ALPHABET = "abcé eñ\xa0 　​﻿\xaḑ́̈ﬁﬂＡｂ１ｶﾞﾊﾟ가각क़क़ำน้ําﻻلا⼈人；;‑-аеоНАTХοΑ\r\n\t…ǅİ😀٣"


def same(text):
    """The form of a text without look-alikes, from the interpreter's own normaliser, sign by sign."""
    t = text.replace("\r\n", "\n")
    out = []
    for ch in t:
        cat = unicodedata.category(ch)
        if cat == "Zs" or ch == "\t":
            out.append(" ")
        elif cat == "Cf":
            continue
        elif ch in "\r":
            out.append("\n")
        elif ch in textform.HYPHENS:
            out.append("-")
        else:
            out.append(textform._decompose(ch))
    s = unicodedata.normalize("NFD", "".join(out))
    for _ in range(len(s)):
        for tone in map(chr, textform.THAI_TONES):
            s = s.replace("ํ" + tone, tone + "ํ")
    return unicodedata.normalize("NFC", s).replace("ํา", "ำ")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=[c for c in ALPHABET if c not in "аеоНАХοΑ"], max_size=30), min_size=1, max_size=20))
def test_against_the_normaliser(texts):
    assert textform.form_column(pa.array(texts)).to_pylist() == [same(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=15))
def test_round_trip_and_fixed_point(texts):
    col = pa.array(texts, pa.string())
    cps, off, valid = cp.decode(col)
    assert cp.encode(cps, off, valid).to_pylist() == texts
    once = textform.form_column(col)
    assert [t is None for t in once.to_pylist()] == [t is None for t in texts]
    assert textform.form_column(once).to_pylist() == once.to_pylist()


def test_thai_marks_behind_several_tones():
    f = lambda t: textform.form_column(pa.array([t])).to_pylist()[0]
    assert f("\u0e4d\u0e49\u0e49") == "\u0e49\u0e49\u0e4d" and f("\u0e01\u0e4d\u0e49\u0e48\u0e32") == f("\u0e01\u0e49\u0e48\u0e33")
    assert textform.form_column(pa.array(["\u0e01\u0e4d", "\u0e49"])).to_pylist() == ["\u0e01\u0e4d", "\u0e49"]


def test_korean_syllables():
    f = lambda t: textform.form_column(pa.array([t])).to_pylist()[0]
    whole = [chr(c) for c in range(0xAC00, 0xD7A4)]
    apart = unicodedata.normalize("NFD", "".join(whole))
    assert f(apart) == "".join(whole)
    assert textform.form_column(pa.array([unicodedata.normalize("NFD", c) for c in whole])).to_pylist() == whole
    assert f("\u1100\u1161\u11a8") == "\uac01" and f("\uac00\u11a8") == "\uac01" and f("\u1100\u1161") == "\uac00"
    assert f("\uac01\u11a8") == "\uac01\u11a8" and f("\u1161\u11a8") == "\u1161\u11a8"
    assert textform.form_column(pa.array(["\u1100", "\u1161"])).to_pylist() == ["\u1100", "\u1161"]  # not across rows
    assert f("\u3131\u314f") == "\u3131\u314f" == f("\uffa1\uffc2")  # letters shown singly stay so


def test_korean_copies(make):
    from inkvane.llm import similarity

    t = "한국어 문장은 여러 글자로 이루어지며 저장 방식에 따라 달라질 수 있습니다. 그래서 같은 글이 다르게 저장되기도 합니다. 이런 글도 하나의 형태로 모아야 합니다."
    df = make([record("a", t), record("b", unicodedata.normalize("NFD", t)), record("c", t.replace("한국어", "일본어"))])
    assert [tuple(r) for r in forms.same_form_pairs(df).collect()] == [("a", "b")]
    pairs = {tuple(r) for r in similarity.near_duplicate_pairs(df).collect()}
    assert pairs == {("a", "b"), ("a", "c"), ("b", "c")}


def test_look_alikes():
    f = lambda t: textform.form_column(pa.array([t])).to_pylist()[0]
    assert f("The mеаѕurеd ѕtаtіоn; Οverall") == "The measured station; Overall"
    assert f("Кoрзинa упалa c полки в aвгуcтe") == "Корзина упала с полки в августе"
    assert f("Нет, это Windows") == "Нет, это Windows"  # a word sure of its script keeps it
    assert f("ＡＢ１ ﬁn   x​­") == "AB1 fin   x"
    assert f("Case É é ½ x² ①") == "Case É é ½ x² ①"  # marks that are seen stay


def test_slices_and_sliced_columns():
    col = pa.array(["ab", None, "", "é" * 50, "z"])
    assert [(int(a), int(b)) for a, b in cp.slices(col, 40)][-1][1] == 5
    cps, off, valid = cp.decode(col.slice(2, 2))
    assert np.diff(off).tolist() == [0, 50] and valid.all()


def test_pairs(make):
    t = "Ｗide fin words and a few more of them."
    rows = [record("a", t), record("b", "Wide ﬁn words and a few more of them."), record("b", "Wide ﬁn words and a few more of them."), record("c", "Wide fin words and a few more of them."), record("d", "wide fin words and a few more of them."),
            record("e", None), record("f", ""), record("g", " "), record("h", " "), record(None, t), record("i", "Wide fin words and a few more of them.")]
    got = {tuple(r) for r in forms.same_form_pairs(make(rows)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "i"), ("b", "i")}  # c and i are equal strings, d differs in case
    assert forms.same_form_pairs(make([])).count() == 0
    out = {r["id"]: r["form"] for r in forms.consistent_form(make(rows)).collect()}
    assert out["a"] == "Wide fin words and a few more of them." and out["e"] is None and out["f"] == ""


def test_a_long_text(make):
    t = "é" * 300_000 + "é" * 3
    got = forms.consistent_form(make([record("a", t)])).collect()[0]["form"]
    assert got == "é" * 300_003


def test_tables_are_sound():
    t = textform.tables()
    assert t.ccc[0x301] == 230 and t.cls[ord("a")] == 1 and not t.trigger[ord("é")] and t.trigger[0x301]
    with pytest.raises(IndexError):
        t.first[0x110000]
    assert random.Random(1).random() < 1


def test_look_alikes_under_accents():
    f = lambda t: textform.form_column(pa.array([t])).to_pylist()[0]
    assert f("зел\u00ebный лес") == "зел\u0451ный лес" and f("caf\u0451 and лес") == "caf\u00eb and лес"
    for t in ("зел\u00ebный лес", "caf\u0451 and лес", "к\u00f3т \u03cc\u03bb\u03b1", "\u0451лка", "L\u00e9on лес"):
        assert f(t + "\u00a0") == f(t) + " "


def test_short_texts_take_no_part(make):
    whole = "Fünfzig Buchstaben und noch einige mehr stehen in diesem langen Satz hier"
    n = len(textform.compared(*cp.decode(pa.array([whole]))[:2])[0])
    df = make([record("a", whole), record("b", unicodedata.normalize("NFD", whole)), record("c", "Zu kurz, ü"), record("d", "Zu kurz, u\u0308")])
    for shortest, want in ((0, {("a", "b"), ("c", "d")}), (n, {("a", "b")}), (n + 1, set())):
        assert {tuple(r) for r in forms.same_form_pairs(df, shortest=shortest).collect()} == want
