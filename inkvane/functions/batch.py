"""Sentences, words and text features of whole Arrow batches: the fast twins of functions.text.

The same rules as in functions.text, whose native columns serve where Python
functions are not allowed (inside higher-order functions). Texts are cut by
compiled patterns; all counting is done on flat arrays of a whole batch, in
time linear in the length of the texts but for sorting.
"""

from __future__ import annotations

import functools
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from .wordlists import ABBREVIATIONS, STOPWORDS

WINDOW = 50
_PARAGRAPH = re.compile(r"\n[ \t]*\n+")
_RUN = re.compile(rf"(?<![.!?])[.!?]++[{tx.CLOSERS}]*+(?=[{tx.SPACE}]|\Z)")
_BEFORE = re.compile(r"[A-Za-z']*\Z")
_SPACES = re.compile(rf"[{tx.SPACE}]*+")
_WORD = re.compile(tx.WORD.replace(r"\p{Nd}", r"\d"))
_SHORT = frozenset(ABBREVIATIONS)
_CAPS = re.compile(r"[A-Z]+(?:'[A-Z]+)*")
_BLANK = re.compile(rf"[{tx.SPACE}]+")
_PUNCT = re.compile(r"[!-/:-@\[-`{-~]+")
_DIGIT = re.compile(r"[\d²³¹⁰⁴-⁹₀-₉]+")


@functools.lru_cache(maxsize=1)
def _space() -> str:
    """The characters of SPACE."""
    return "".join(c for c in map(chr, range(0x3001)) if _BLANK.fullmatch(c))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence."""
    out, space = [], _space()

    def add(a, b):
        part = text[a:b]
        left = part.lstrip(space)
        if left:
            a += len(part) - len(left)
            out.append((a, a + len(left.rstrip(space))))

    def paragraph(at, stop):
        part = text[at:stop]
        done = 0
        for m in _RUN.finditer(part):
            i = m.start()
            if part[i] == "." and part[i + 1 : i + 2] not in (".", "!", "?"):  # a lone period
                word = _BEFORE.search(part, max(0, i - 64), i).group()
                if len(word) < 64:
                    core = word.lstrip("'")
                    if len(word) - len(core) <= 16 and (len(core) == 1 or core.lower() in _SHORT):
                        continue
            add(at + done, at + m.end())
            done = m.end()
        add(at + done, stop)

    at = 0
    for m in _PARAGRAPH.finditer(text):
        paragraph(at, m.start())
        at = m.end()
    paragraph(at, len(text))
    return out


def sentences(text: Column) -> Column:
    """array<struct<sid, start, end, text>> as text.sentences gives it, by batches; null for null."""

    @F.pandas_udf("array<struct<sid:int,start:int,end:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"sid": k, "start": a, "end": b, "text": t[a:b]} for k, (a, b) in enumerate(sentence_spans(t))] for t in texts], dtype=object)

    return run(text)


def explode_words(df, key: str, text: str, offsets: bool):
    """(key, sid, pos, word[, start, end]) of every word, straight from the batches of a table."""
    src = df.select(F.col(key), F.col(text).alias("_text_"))
    kind = src.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, sid int, pos int, word string" + (", start int, end int" if offsets else "")

    def run(batches):
        for batch in batches:
            rows, sids, places, words, starts = [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for sid, (a, b) in enumerate(sentence_spans(t) if t else ()):
                    found = _WORD.findall(t, a, b) if not offsets else [m for m in _WORD.finditer(t, a, b)]
                    rows += [k] * len(found)
                    sids += [sid] * len(found)
                    places += range(len(found))
                    if offsets:
                        starts += [m.start() for m in found]
                        words += [m.group() for m in found]
                    else:
                        words += found
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sids, pa.int32()), pa.array(places, pa.int32()), pa.array(words, pa.string())]
            names = [key, "sid", "pos", "word"]
            if offsets:
                at = np.array(starts, np.int32)
                cols += [pa.array(at), pa.array(at + np.fromiter(map(len, words), np.int32, len(words)))]
                names += ["start", "end"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, fields)


def _ratio(a, b, otherwise=0.0):
    b = np.asarray(b)
    return np.where(b == 0, otherwise, np.asarray(a) / np.where(b == 0, 1, b))


class _Flat:
    """Sentences and words of a batch as flat arrays."""

    def __init__(self, texts: list[str]):
        self.rows = len(texts)
        spans = [sentence_spans(t) for t in texts]
        per = [_WORD.findall(t, a, b) for t, s in zip(texts, spans) for a, b in s]
        self.s_row = np.repeat(np.arange(self.rows), [len(s) for s in spans])
        self.s_words = np.array([len(w) for w in per], np.int64)
        self.s_chars = np.array([b - a for s in spans for a, b in s], np.int64)
        self.words = list(chain.from_iterable(per))
        self.row = np.repeat(self.s_row, self.s_words)
        self.low = [w.lower() for w in self.words]
        table: dict[str, int] = {}
        self.id = np.fromiter((table.setdefault(w, len(table)) for w in self.low), np.int64, len(self.low))
        self.n = np.bincount(self.row, minlength=self.rows)
        self.first = np.cumsum(self.n) - self.n

    def sum(self, values):
        return np.bincount(self.row, weights=values, minlength=self.rows).astype(np.int64)


def _moments(row, x, rows):
    """Count, mean, deviation, least and greatest of x by row; 0 where there is none."""
    n = np.bincount(row, minlength=rows)
    s = np.bincount(row, weights=x, minlength=rows).astype(np.int64)
    q = np.bincount(row, weights=x * x, minlength=rows).astype(np.int64)
    low, high = np.full(rows, np.iinfo(np.int64).max), np.zeros(rows, np.int64)
    np.minimum.at(low, row, x)
    np.maximum.at(high, row, x)
    std = np.where(n < 2, 0.0, np.sqrt(np.maximum(n * q - s * s, 0).astype(float)) / np.maximum(n, 1))
    return n, _ratio(s, n), std, np.where(n > 0, low, 0), high


def _sentence(f: _Flat, out):
    n, m, s, low, high = _moments(f.s_row, f.s_words, f.rows)
    _, mc, sc, _, _ = _moments(f.s_row, f.s_chars, f.rows)
    for k, v in zip(("count", "mean_len_words", "std_len_words", "min_len_words", "max_len_words", "mean_len_chars", "std_len_chars", "len_words_cv", "len_words_burstiness"), (n, m, s, low, high, mc, sc, _ratio(s, np.abs(m)), _ratio(s - m, s + m))):
        out[f"sent_{k}"] = v


def _lexical(f: _Flat, out):
    place = np.arange(len(f.row)) - f.first[f.row]
    order = np.lexsort((place, f.id, f.row))
    row, word, at = f.row[order], f.id[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(row)))
    types = np.bincount(row[start], minlength=f.rows)
    once = np.bincount(row[start], weights=size == 1, minlength=f.rows)
    before = np.where(new, -1, np.concatenate(([-1], at[:-1]))) if len(row) else at
    # windows in which a word is the first of its type
    fresh = np.maximum(np.minimum(at, f.n[row] - WINDOW) - np.maximum(np.maximum(before + 1, at - (WINDOW - 1)), 0) + 1, 0)
    fresh = np.bincount(row, weights=fresh, minlength=f.rows)
    ttr = _ratio(types, f.n)
    out["lex_ttr"], out["lex_hapax_ratio"] = ttr, _ratio(once, types)
    out["lex_mattr_w50"] = np.where(f.n <= WINDOW, ttr, fresh / (WINDOW * np.maximum(f.n - WINDOW + 1, 1)))


def _grams(f: _Flat, k: int):
    """Number of n-grams, of different ones, and of the commonest, by row."""
    n = np.maximum(f.n - (k - 1), 0)
    if not len(f.row):
        return n, n, n
    code = f.id
    for i in range(1, k):  # numbers of pairs, then of triples
        pair = np.stack((code[:-1], f.id[i:]))
        _, code = np.unique(pair[0] << np.int64(32) | pair[1], return_inverse=True)
    row = f.row[: len(code)]
    inside = row == f.row[k - 1 :]
    key, count = np.unique(row[inside].astype(np.int64) << np.int64(40) | code[inside], return_counts=True)
    most = np.zeros(f.rows, np.int64)
    np.maximum.at(most, key >> np.int64(40), count)
    return n, np.bincount(key >> np.int64(40), minlength=f.rows), most


def _repetition(f: _Flat, out):
    for k in (1, 2, 3):
        n, types, most = _grams(f, k)
        out[f"rep_distinct_{k}"] = _ratio(types, n, 1.0)
        if k > 1:
            out[f"rep_top_{'bi' if k == 2 else 'tri'}gram_share"] = _ratio(most, n)
    some = f.s_words > 0
    head = (np.cumsum(f.s_words) - f.s_words)[some]
    row = f.s_row[some]
    key = np.unique(row.astype(np.int64) << np.int64(40) | f.id[head])
    n, types = np.bincount(row, minlength=f.rows), np.bincount(key >> np.int64(40), minlength=f.rows)
    out["rep_repeated_sentence_start_ratio"] = np.where(n == 0, 0.0, 1.0 - _ratio(types, n))


def _style(f: _Flat, out, texts, every):
    hits = lambda words: f.sum(np.fromiter((w in words for w in f.low), bool, len(f.low)))
    size = np.fromiter(map(len, f.words), np.int64, len(f.words))
    lost = lambda p: np.array([len(t) - len(p.sub("", t)) for t in texts], np.int64)
    solid = np.array([len(_BLANK.sub("", t)) for t in texts], np.int64)
    caps = f.sum(np.fromiter((len(w) > 1 and _CAPS.fullmatch(w) is not None for w in f.words), bool, len(f.words)))
    comma, semi = (np.array([t.count(c) for t in texts], np.int64) for c in ",;")
    for k, (a, b) in {"stopword_ratio": (hits(frozenset(STOPWORDS)), f.n), "common_word_ratio": (hits(every), f.n), "avg_word_length": (f.sum(size), f.n), "punct_char_ratio": (lost(_PUNCT), solid), "comma_rate": (comma, f.n), "semicolon_rate": (semi, f.n), "digit_char_ratio": (lost(_DIGIT), solid), "allcaps_word_ratio": (caps, f.n)}.items():
        out[f"style_{k}"] = _ratio(a, b)


def text_features(texts: list[str | None], groups: tuple[str, ...], common: frozenset[str] = frozenset()) -> dict[str, np.ndarray]:
    """The features of the given groups, an array each. A null text counts as empty."""
    texts = [t or "" for t in texts]
    f, out = _Flat(texts), {}
    if "sentence" in groups:
        _sentence(f, out)
    if "lexical" in groups:
        _lexical(f, out)
    if "repetition" in groups:
        _repetition(f, out)
    if "style" in groups:
        _style(f, out, texts, common | frozenset(STOPWORDS))
    return {k: np.asarray(v, float) for k, v in out.items()}


def features(text: Column, names: list[str], groups: tuple[str, ...], common: list[str]) -> Column:
    """struct of the named features of a text, by batches."""
    words = frozenset(w.lower() for w in common)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        got = text_features(list(texts), groups, words)
        return pd.DataFrame({n: got[n] for n in names})

    return run(text)
