import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkvane.llm import mixing, pieces, tokens

public = pytest.importorskip("public_tokenizers")
RANKS = tokens.read_ranks()
CASES = ["", "Hello world", "  two  spaces\n\n\tand tabs ", "I'll don't we're 'quoted'", "naïve café 北京大学 日本語 ไทย हिन्दी", "<|endoftext|> is text", "12345 3.14 ٣٤", "😀🏽 \x00\x07", "a" * 3000, "汉" * 900, "\r\n\r\n ", "x" + "​" * 50]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def lexicon(words):
    words = sorted({w.encode("utf-8") for w in words})
    return tokens.Lexicon.compile(words, [tokens.merge(w, RANKS) for w in words])


@pytest.mark.parametrize("text", CASES)
def test_ids(reference, text):
    assert tokens.Encoder(RANKS)(text) == tokens.Encoder(RANKS, lexicon([" world", "Hello", "日本語", " "]))(text) == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    from tokenizers import Tokenizer

    t = test_any_text.__dict__.setdefault("t", Tokenizer.from_file(public.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    assert tokens.Encoder(RANKS)(text) == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=6), max_size=20))
def test_lexicon(words, others):
    words = sorted(set(words))
    lex = tokens.Lexicon.compile(words, [[i, i + 1] for i in range(len(words))])
    with tempfile.NamedTemporaryFile() as f:
        f.write(lex.save())
        f.flush()
        lex = tokens.Lexicon.map(f.name)
    index = {w: [i, i + 1] for i, w in enumerate(words)}
    assert lex.find(words + others) == [index.get(w) for w in words + others]


def test_suffixes_are_shared():
    many = [f"{a}{b}ing".encode() for a in "abcdefgh" for b in "rstuv"]
    assert len(tokens.Lexicon.compile(sorted(many), [[0]] * len(many)).final) <= 8


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string, ids string, bucket int, word string")


def test_table(spark, reference):
    rows = [(i, t) for i, t in enumerate([*CASES, None, CASES[1]])] + [(None, "Hello"), (1, "Hello world")]
    df = documents(spark, [(i, t, None, "x", "x", 1, "x") for i, t in rows])
    got = sorted(((r["doc_id"], list(r["ids"])) for r in tokens.encode(df).collect()), key=str)
    assert got == sorted(((i, reference(t) if t else []) for i, t in rows), key=str)
    assert tokens.encode(documents(spark, [])).count() == 0


TARGETS = "source string, share_bp int, max_repeats int"


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, None, rng.choice([" Big", "big", "mid"]) if i % 40 else "tiny", rng.randint(0, 30)) for i in range(600)] + [(900, None, None, 4000)]
    docs = spark.createDataFrame([(i, s and s.strip().lower(), n, 1.0, "x") for i, _, s, n in rows], "doc_id long, source string, n_tokens long, order double, all string")
    targets = spark.createDataFrame([("big", 5000, 3), ("mid", 3000, 3), ("tiny", 2000, 2), ("gone", 0, 4)], TARGETS)
    s = mixing.supply(docs, targets)
    total = sum(n for *_, n in rows)
    assert {r["budget"] for r in s.collect()} == {total // 2}
    tiny = sum(n for _, _, x, n in rows if x == "tiny")
    assert {r["source"] for r in mixing.short(mixing.queue(docs, s), s).collect()} == {"tiny"} and tiny * 2 < 0.2 * (total // 2)
    out = mixing.mix(docs, targets).collect()
    used = {}
    for r in out:
        used.setdefault(r["source"], []).append(r)
    got = sum(r["n_tokens"] for r in out)
    assert total // 2 - 31 <= got <= total // 2 and sorted(r["position"] for r in out) == list(range(1, len(out) + 1))
    assert max(r["copy"] for r in used["tiny"]) == 1 and sum(r["n_tokens"] for r in used["tiny"]) == 2 * tiny
    share = {k: sum(r["n_tokens"] for r in v) for k, v in used.items()}
    assert share["big"] / share["mid"] == pytest.approx(5 / 3, rel=0.03)
    assert len({(r["doc_id"], r["copy"]) for r in out}) == len(out)
    rep = {r["source"]: r for r in mixing.report(mixing.mix(docs, targets), s).collect()}
    assert rep["tiny"]["falls_short"] and not rep["big"]["falls_short"] and rep["gone"]["tokens"] == 0


@pytest.mark.parametrize("shares", [(1000, 500, 100), (9000, 8000, 7000), (4000, 3500, 2500)])
def test_short_sources(spark, shares):
    """Shares that sum to less or more than the whole; against plain arithmetic."""
    rng = random.Random(sum(shares))
    rows = [(i, rng.choice("aaaaaabbbc"), rng.randint(0, 50)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    plan = list(zip("abc", shares, (1, 3, 2))) + [("none", 10, 5)]
    s = mixing.supply(docs, spark.createDataFrame(plan, TARGETS))
    budget = sum(n for *_, n in rows) // 2
    want = {x for x, bp, k in plan if sum(n for _, y, n in rows if y == x) * k * 10000 < bp * budget}
    assert {r["source"] for r in mixing.short(mixing.queue(docs, s), s).collect()} == want


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 10000, 2)], TARGETS)
    assert mixing.mix(docs, targets).count() == 0 and mixing.short(mixing.queue(docs, mixing.supply(docs, targets)), mixing.supply(docs, targets)).count() == 0
    one = spark.createDataFrame([(1, "a", 10), (2, "b", 90)], "doc_id long, source string, n_tokens long")
    assert [tuple(r)[:3] for r in mixing.mix(one, targets).orderBy("position").collect()] == [(1, "a", 0), (1, "a", 1)]  # all that may be used
    assert mixing.mix(one, spark.createDataFrame([], TARGETS)).count() == 0


def encoder():
    e = tokens.Encoder(RANKS)
    e.width = pieces.widths(RANKS)
    return e


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "Sentence ends.", "\n\n", "北京", "x" * 40, "😀", " ", "1234", "\n", "é"]), min_size=0, max_size=120), st.integers(4, 60), st.integers(0, 12))
def test_pieces(parts, most, overlap):
    e, t = encoder(), " ".join(parts)
    overlap = min(overlap, most // 3)
    got = pieces.cut_text(t, e, most, overlap)
    if len(e(t)) <= most:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(t)
    assert all(len(e(t[a:b])) == n <= max(most, len(e(t[a:b])) if b - a == 1 else 0) for a, b, n, _ in got)
    assert all(x[0] < y[0] <= x[1] < y[1] for x, y in zip(got, got[1:]))


def test_pieces_prefer_strong_boundaries():
    t = "\n\n".join(" ".join(f"Sentence {i} of part {k} stands here." for i in range(12)) for k in range(6))
    got = pieces.cut_text(t, encoder(), 200, 20)
    assert all(s >= 3 for *_, s in got)


def test_pieces_table(spark):
    limits = spark.createDataFrame([(64, 8)], "max_tokens int, overlap_tokens int")
    long = " ".join(f"Word number {i}." for i in range(400))
    df = spark.createDataFrame([(1, long, 0), (2, "short", 0), (3, None, 0), (4, "", 0), (1, long, 0), (5, "z" * 5000, 0)], "doc_id long, text string, piece_no int")
    rows = pieces.split(df, limits).collect()
    assert {r["doc_id"] for r in rows} == {1, 5} and max(r["n_tokens"] for r in rows) <= 64
    assert all(r["piece"] == {1: long, 5: "z" * 5000}[r["doc_id"]][r["start_pos"] : r["end_pos"]] for r in rows)
    assert pieces.split(df.where("false"), limits).count() == 0 and pieces.split(df, limits.where("false")).count() == 0


def test_pieces_of_a_very_long_text():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 5)))
    t = " ".join(" ".join(word() for _ in range(rng.randint(2, 6))).capitalize() + "." for _ in range(9000))
    e = encoder()
    n = len(e(t))
    got = pieces.cut_text(t, e, 512, 48)
    least = -(-(n - 48) // (512 - 48))
    assert least > 150 and least <= len(got) <= 1.1 * least and max(x[2] for x in got) <= 512
    assert min(x[3] for x in got) > pieces.TOKEN and sum(x[3] >= pieces.SENTENCE for x in got) > 0.8 * len(got)
