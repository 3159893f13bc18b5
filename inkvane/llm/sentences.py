"""Problem 6: sentence boundaries across languages and scripts.

Learning, unsupervised and per language, over all texts: which word types
carry a period as abbreviations (log-likelihood ratio of type and period, and
what follows them), which numbers and words form collocations across a period
("No. 12", "3. Mai"), and which words start sentences. Then each mark that may
end a sentence is classified by these statistics, by letter case where the
script and the text have it, and by the closing quotes around it.

Fixed behaviour
  * Null and blank texts give no sentences; offsets are code points of the text
    as delivered, without white space around.
  * A blank line always ends a sentence, a single line break never by itself.
  * Signs that can't be seen are looked through but keep their offsets.
  * In paragraphs of Thai, white space ends a sentence.
"""

from __future__ import annotations

import os
import re
import sqlite3
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_dir, cut

CHI_999 = 10.83  # chi-square, one degree of freedom, 0.1 per cent
MANY = 30.0  # the bar where a whole vocabulary is tested, as Kiss and Strunk set it for sentence starters
HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤⁦-⁯﻿︀-️]")
BLANK_LINE = re.compile(r"(?:\r\n|\n|\r| | )(?:[^\S\r\n  ]*(?:\r\n|\n|\r| | ))+")
CLOSERS = "\"'’”»)）]】」』》〉›"
FULL = "。！？｡．।॥؟‼⁇⁈⁉"
MARKS = re.compile(rf"[.!?…{FULL}]+")
#: Letters and marks of the scripts that set words apart.
L = "[A-Za-zªµºÀ-ÖØ-öø-ʯ̀-ͽͿ-ԯԱ-ֈא-תؠ-ٟٱ-ۓऀ-ॣॱ-ൿႠ-ჿḀ-῿가-힯Ａ-Ｚａ-ｚ]"
WORD = re.compile(f"{L}+(?:['’.-]{L}+)*")
_BACK = re.compile(rf"({L}+(?:\.{L}+)*)|[\d.,]*\d")
_PERIOD = re.compile(r"\.(?=[\s,;:)\]”»\"']|$)")
_BEHIND = re.compile(rf"[)\]”»\"']*(\s+|(?=[,;:])|$)({L}+|\S|$)")
CAPITAL = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]")
STARTS = re.compile(r"(?:^|\n\s*\n|[.!?]\s+)[\"“„«‘'(]*([^\W\d_])")
THAI = re.compile("[฀-๿]+")
#: Cyrillic and Greek letters drawn like Latin ones, for looking words up.
_TWINS = str.maketrans("аеорсухіѕјονАВЕКМНОРСТХІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjovABEKMHOPCTXISJABEZHIKMNOPTYX")
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)}
LATIN = re.compile("[A-Za-zÀ-ɏ]")
NUMBER = "##"
CACHE = 200_000  # looked-up types a worker keeps
POOL = ""  # stands for the language of texts that have none and give no guess


def _before(text: str, lo: int, at: int) -> str:
    """The word, dotted word or number that ends at a place."""
    far = 40
    while True:
        m = _BACK.match(text[max(lo, at - far) : at][::-1])
        if not m or m.end() < far - 1 or at - far <= lo:  # it ends before the window does
            return m.group()[::-1] if m else ""
        far *= 4


def _plain(word: str) -> str:
    """A word as it is looked up: half width, look-alikes undone where Latin letters stand beside them, lower case."""
    if not word.isascii():
        word = unicodedata.normalize("NFC", word).translate(_WIDE)
        if LATIN.search(word):
            word = word.translate(_TWINS)
    return word.lower()


def _lower_style(text: str) -> bool:
    """Whether letter case says nothing in this text: nearly no capital, and its sentences seem to start small."""
    if 100 * len(CAPITAL.findall(text)) > len(text):
        return False
    first = STARTS.findall(text)
    return sum(map(str.islower, first)) >= 0.7 * max(1, len(first))


def _collect(batches, frequent=None):
    """Counts of one part: rows (lang, kind, a, b, cat, n); with frequent words, texts without a language get a guess or the pool."""
    counts: dict[tuple, Counter] = {}

    def rows():
        for (lang, kind), c in counts.items():
            keys = list(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array([kind] * len(keys), pa.string()), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([c[k] for k in keys], pa.int64())],
                ["lang", "kind", "a", "b", "cat", "n"],
            )

    def fold(lang):
        """Raw words of a language into counts of plain words; cat 1 counts those in lower case where case tells."""
        c = counts.setdefault((lang, "w"), Counter())
        for lower_style, words in enumerate(raw.pop(lang)):
            for w, n in words.items():
                p = _plain(w)
                c[p, "", 0] += n
                if not lower_style and w[0].islower():
                    c[p, "", 1] += n

    raw: dict[str, tuple[Counter, Counter]] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            if not lang:
                lang = guess_language(text, frequent) or POOL
            if not text.isascii():
                text = HIDDEN.sub("", text)
            lower_style = _lower_style(text)
            if lang not in raw:
                raw[lang] = Counter(), Counter()
            raw[lang][lower_style].update(WORD.findall(text))
            ends = counts.setdefault((lang, "c"), Counter())
            for m in _PERIOD.finditer(text):
                a = _before(text, 0, m.start())
                if not a:
                    continue
                m = _BEHIND.match(text, m.end())
                if not m:
                    continue
                after, nxt = m[1], m[2]
                if len(nxt) > 2 and nxt.isupper() and len(a) > 2 and a.isupper():
                    continue  # a line in capitals
                a = NUMBER if a[0].isdigit() else _plain(a)
                if nxt == "":
                    cat, b = 5, ""
                elif nxt[0].isdigit():
                    cat, b = 2, ""
                elif nxt[0] in ",;:":
                    cat, b = 4, ""
                elif nxt[0].islower():
                    cat, b = (6, "") if lower_style else (1, "")
                elif nxt[0].isupper() and after and not BLANK_LINE.search(after):
                    cat, b = 3, _plain(nxt)
                else:
                    cat, b = 5, ""
                ends[a, b, cat] += 1
        if sum(map(len, counts.values())) + sum(len(x) for v in raw.values() for x in v) > 500_000:
            for lang in list(raw):
                fold(lang)
            yield from rows()
            counts.clear()
    for lang in list(raw):
        fold(lang)
    yield from rows()


def _llr(k1, n1, k2, n2):
    """Log-likelihood ratio of two binomial counts, k1 of n1 and k2 of n2, as a column."""
    def ll(k, n, p):
        q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
        return k * F.ln(q) + (n - k) * F.ln(1 - q)

    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / F.greatest(n1, F.lit(1)), k2 / F.greatest(n2, F.lit(1))
    return 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))


class Types(Mapping):
    """The learned types of one kind and language, looked up in the model's file with a bounded cache."""

    _files: dict[str, tuple[sqlite3.Connection, dict]] = {}

    def __init__(self, name: str, what: str, lang: str):
        self.name, self.what, self.lang = name, what, lang

    def _file(self):
        if self.name not in Types._files:
            path = Path(SparkFiles.get(self.name)).resolve()
            Types._files[self.name] = sqlite3.connect(f"{path.as_uri()}?mode=ro&immutable=1", uri=True, check_same_thread=False), {}
        return Types._files[self.name]

    def _row(self, a):
        db, cache = self._file()
        key = self.what, self.lang, a
        try:
            return cache[key]
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            row = cache[key] = db.execute("select ends from types where what = ? and lang = ? and a = ?", key).fetchone()
            return row

    def __contains__(self, a):
        return self._row(a) is not None

    def __getitem__(self, a):
        row = self._row(a)
        if row is None:
            raise KeyError(a)
        return row[0]

    def __iter__(self):
        return (a for a, in self._file()[0].execute("select a from types where what = ? and lang = ?", (self.what, self.lang)))

    def __len__(self):
        return self._file()[0].execute("select count(*) from types where what = ? and lang = ?", (self.what, self.lang)).fetchone()[0]


def publish(spark: SparkSession, rows) -> tuple[str, set]:
    """Writes rows (what, lang, a, ends) as they come into a file that every executor fetches; its name and the pairs (what, lang)."""
    name, seen = f"sentences-{uuid.uuid4().hex}.db", set()

    def each():
        for r in rows:
            seen.add((r["what"], r["lang"]))
            yield r["what"], r["lang"], r["a"], r["ends"]

    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, name)
        db = sqlite3.connect(local)
        db.execute("create table types (what text, lang text, a text, ends real, primary key (what, lang, a)) without rowid")
        db.executemany("insert into types values (?, ?, ?, ?)", each())
        # types that several languages shorten
        db.execute("insert into types select 'shared', '', a, 0.0 from types where what = 'abbr' and length(a) > 1 group by a having count(*) > 1")
        db.commit()
        db.close()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(checkpoint_dir(spark), name)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.copyFromLocalFile(False, True, hadoop.Path(Path(local).as_uri()), path)
        spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name, seen


class Model:
    """What was learned: abbreviations with how readily they end sentences, number collocations, starters, frequent words."""

    def __init__(self, abbreviations, before_number, after_number, starters, frequent, shared=None):
        self.abbreviations = abbreviations  # lang -> {type: share of capitals after it that start a sentence}
        self.before_number, self.after_number, self.starters, self.frequent = before_number, after_number, starters, frequent
        if shared is None:
            known = Counter(a for v in abbreviations.values() for a in v)
            shared = frozenset(a for a, n in known.items() if n > 1 and len(a) > 1)
        self.shared = shared  # types that several languages shorten


def _frequent(c: DataFrame) -> dict[str, frozenset]:
    """The words that make up 0.2 per cent of their language's words, at most 500 a language."""
    words = c.where("kind = 'w' and cat = 0").groupBy("lang", "a").agg(F.sum("n").alias("n"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("words"))
    out: dict[str, set] = {}
    for r in words.join(F.broadcast(totals), "lang").where(F.col("n") >= 0.002 * F.col("words")).collect():
        out.setdefault(r["lang"], set()).add(r["a"])
    return {l: frozenset(v) for l, v in out.items()}


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all texts.

    Texts without a language are counted in a second pass, under the language
    that the frequent words of the first suggest, or else in a pool of their
    own. Types are counted over all rows; each of at least 2 occurrences is tested,
    whatever the corpus. The learned types may be many: they go row by row
    into a file that the tasks look them up in. Only frequent words, at most
    500 a language, are held by the driver.
    """
    src = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    fields = "lang string, kind string, a string, b string, cat int, n long"
    add = lambda d: d.groupBy("lang", "kind", "a", "b", "cat").agg(F.sum("n").alias("n"))
    labelled = cut(add(src.where("lang != ''").mapInArrow(_collect, fields)))
    first = _frequent(labelled)
    c = cut(add(labelled.unionByName(src.where("lang = ''").mapInArrow(lambda batches: _collect(batches, first), fields))))
    heavy = first | _frequent(c.where(F.col("lang") == POOL))
    words = c.where("kind = 'w'").groupBy("lang", "a").agg(F.sum(F.when(F.col("cat") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("cat") == 1, F.col("n")).otherwise(0)).alias("low"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("words"))
    ends = c.where("kind = 'c'")
    ortho = words.select("lang", F.col("a").alias("b"), ((F.col("low") * 20 > F.col("n")) & (F.length("a") > 1)).alias("common"))
    dotted = ends.groupBy("lang", F.col("a").alias("b")).agg(F.sum("n").alias("b_dots"), F.sum(F.when(F.col("cat").isin(1, 2, 4), F.col("n")).otherwise(0)).alias("b_inside"))
    ends = ends.join(ortho, ["lang", "b"], "left").join(dotted.join(words.select("lang", F.col("a").alias("b"), F.col("n").alias("b_n")), ["lang", "b"]).where("b_dots >= 0.8 * b_n and b_inside >= 2").select("lang", "b", F.lit(True).alias("b_dotted")), ["lang", "b"], "left")
    n = F.col("n")
    pick = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    per = ends.groupBy("lang", "a").agg(
        F.sum("n").alias("dots"), pick(F.col("cat").isin(1, 4)).alias("inside"), pick(F.col("cat") == 2).alias("digit"),
        pick((F.col("cat") == 3) & F.coalesce("common", F.lit(False))).alias("common"), pick((F.col("cat") == 3) & ~F.coalesce("common", F.lit(False))).alias("name"), F.sum(((F.col("cat") == 3) & ~F.coalesce("common", F.lit(False))).cast("int")).alias("names"), pick((F.col("cat") == 3) & F.coalesce("b_dotted", F.lit(False))).alias("paired"), pick(F.col("cat").isin(5, 6)).alias("other"))
    alldots = per.where(F.col("a") != NUMBER).groupBy("lang").agg(F.sum("dots").alias("alldots"), F.sum("digit").alias("alldigits"), F.sum("common").alias("allcommon"), F.sum("name").alias("allname"))
    t = per.join(words.select("lang", "a", "n"), ["lang", "a"]).join(F.broadcast(totals), "lang").join(F.broadcast(alldots), "lang")  # one row a language
    t = t.where(F.col("n") >= 2)
    with_dot = _llr(F.col("dots"), F.greatest("n", "dots"), F.greatest(F.col("alldots") - F.col("dots"), F.lit(0)), F.greatest(F.col("words") - F.col("n"), F.col("alldots") - F.col("dots"), F.lit(1)))
    high = F.col("dots") / F.greatest("n", "dots") >= 0.8
    length = F.length(F.regexp_replace("a", r"\.", ""))
    starts = F.col("common") + F.col("other")
    # an ordinary last word of a sentence is followed by what starts sentences; an abbreviation is followed by what does not
    followed = (F.col("inside") + F.col("digit") >= F.greatest(F.lit(2.0), 0.05 * F.col("dots"))) | ((starts <= 0.1 * F.col("dots")) & (F.col("names") >= 3))
    followed |= (starts <= 0.1 * F.col("dots")) & (F.col("paired") >= 3) & (2 * F.col("paired") >= F.col("dots"))
    short = (length == 1) | F.col("a").contains(".")  # initials and dotted types are abbreviations by form
    abbr = t.where((F.col("a") != NUMBER) & high & (followed | short) & (with_dot * F.exp(-length / 2) > 0.3)).select("lang", "a", (F.col("common") / F.greatest(F.col("common") + F.col("name"), F.lit(1))).alias("ends"), (F.col("common") + F.col("name")).alias("caps"))
    number = t.where((F.col("digit") >= 2) & (F.col("digit") >= 0.6 * F.col("dots")) & (_llr(F.col("digit"), F.col("dots"), F.col("alldigits") - F.col("digit"), F.greatest(F.col("alldots") - F.col("dots"), F.lit(1))) > CHI_999)).select("lang", "a")
    # capitals behind periods: of each word behind numbers (k) and behind words (kw), and of all words (numbers, capitals)
    behind = ends.where("cat = 3").groupBy("lang", "b").agg(pick(F.col("a") == NUMBER).alias("k"), pick(F.col("a") != NUMBER).alias("kw"), F.max("common").alias("common"))
    sums = behind.groupBy("lang").agg(F.sum("k").alias("numbers"), F.sum("kw").alias("capitals"))
    behind = behind.join(words.select("lang", F.col("a").alias("b"), "n", "low"), ["lang", "b"]).join(F.broadcast(sums), "lang").join(F.broadcast(totals), "lang")
    rest = lambda k, of: F.greatest(F.col(of) - F.col(k), F.lit(0))
    more = lambda k, of, k2, of2: (_llr(F.col(k), F.col(of), k2, F.greatest(of2, k2, F.lit(1))) > MANY) & (F.col(k) * of2 > k2 * F.col(of))
    # a word that starts sentences anyway is no more frequent behind numbers than behind words
    after = behind.where((F.col("k") >= 2) & (F.col("low") * 20 <= F.col("n")) & more("k", "numbers", rest("k", "n"), rest("numbers", "words")) & more("k", "numbers", F.col("kw"), F.col("capitals"))).select("lang", F.col("b").alias("a"))
    starter = behind.where(F.col("common") & (F.col("kw") >= 2) & more("kw", "capitals", rest("kw", "n"), rest("capitals", "words"))).select("lang", F.col("b").alias("a"))
    kinds = {"abbr": abbr, "number": number, "after": after, "starter": starter}
    tagged = [d.select(F.lit(k).alias("what"), "lang", "a", (F.when(F.col("caps") >= 3, F.col("ends")) if k == "abbr" else F.lit(None).cast("double")).alias("ends")) for k, d in kinds.items()]
    union = tagged[0]
    for d in tagged[1:]:
        union = union.unionByName(d)
    name, seen = publish(df.sparkSession, union.toLocalIterator())  # one partition at a time
    found = {k: {l: Types(name, k, l) for what, l in seen if what == k} for k in kinds}
    return Model(*found.values(), heavy, Types(name, "shared", ""))


def guess_language(text: str, frequent: dict[str, frozenset]) -> str | None:
    """The language whose frequent words cover most of the text's words; null if none does."""
    hits = dict.fromkeys((l for l in frequent if l != POOL), 0)
    for m in WORD.finditer(text):
        w = _plain(m.group())
        for l in hits:
            hits[l] += w in frequent[l]
    best = max(((n, l) for l, n in hits.items()), default=(0, None))
    return best[1] if best[0] else None


class Abbreviations:
    """Those of a language, and those that several languages shorten, for passages in another language."""

    def __init__(self, model: Model, lang: str | None):
        self.own, self.shared, self.frequent = model.abbreviations.get(lang, {}), model.shared, model.frequent.get(lang, ())

    def __contains__(self, a):
        return a in self.own or (a in self.shared and a not in self.frequent)

    def get(self, a):
        return self.own[a] if a in self.own else 0.0 if a in self else None


class Splitter:
    def __init__(self, model: Model, lang: str | None):
        self.abbr = Abbreviations(model, lang)
        self.number = model.before_number.get(lang, ())
        self.after = model.after_number.get(lang, ())
        self.starters = model.starters.get(lang, ())

    def spans(self, text: str) -> list[tuple[int, int]]:
        place = None
        if not text.isascii() and HIDDEN.search(text):
            place, at = [], 0
            for m in HIDDEN.finditer(text):
                place += range(at, m.start())
                at = m.end()
            place += range(at, len(text))
            clean = HIDDEN.sub("", text)
        else:
            clean = text
        lower_style = _lower_style(clean)
        out, at = [], 0
        for m in BLANK_LINE.finditer(clean):
            self._paragraph(clean, at, m.start(), lower_style, out)
            at = m.end()
        self._paragraph(clean, at, len(clean), lower_style, out)
        if place is None:
            return out
        n = len(text)
        res = []
        for a, b in out:
            end = place[b - 1] + 1
            while end < n and HIDDEN.match(text[end]):  # hidden signs right behind the last mark belong to it
                end += 1
            res.append((place[a], end))
        return res

    def _paragraph(self, t, lo, hi, lower_style, out):
        part = t[lo:hi]
        if not part.strip():
            return
        if not part.isascii() and THAI.search(part):
            thai = sum(map(len, THAI.findall(part)))
            if 2 * thai > sum(1 for c in part if c.isalpha() or "฀" <= c <= "๿"):
                out += [(lo + m.start(), lo + m.end()) for m in re.finditer(r"\S+", part)]
                return
        start = 0
        for m in MARKS.finditer(part):
            if m.start() < start:
                continue
            end = self._end(part, m, start, lower_style)
            if end:
                self._add(part, start, end, lo, out)
                start = end
        self._add(part, start, len(part), lo, out)

    @staticmethod
    def _add(part, a, b, lo, out):
        s = part[a:b]
        left = len(s) - len(s.lstrip())
        s = s.strip()
        if s:
            out.append((lo + a + left, lo + a + left + len(s)))

    def _closers(self, part, i, start, run):
        """The end of the closing signs behind i; German closing quotes and guillemets behind a blank count."""
        n = len(part)
        while i < n:
            c = part[i]
            if c in CLOSERS:
                if c in "\"'" and i + 1 < n and part[i + 1].isalnum():
                    break
                i += 1
            elif c == "“" and part.rfind("„", start, i) > part.rfind("“", start, i):
                i += 1
            elif c.isspace() and i + 1 < n and part[i + 1] in "»" and "«" in part[start:i] and part.rfind("«", start, i) > part.rfind("»", start, i):
                i += 2
            else:
                break
        return i

    def _end(self, part, m, start, lower_style):
        """Where the sentence ends if this run of marks ends it, else 0."""
        run, i = m.group(), m.end()
        end = self._closers(part, i, start, run)
        closed = end > i
        n = len(part)
        j = end
        while j < n and part[j].isspace():
            j += 1
        if j >= n:
            return n
        gap, nxt = j > end, part[j]
        last = run[-1]
        pause = run in ("...", "…", "……") or (len(run) > 1 and set(run) <= {".", "…"})
        if not gap and last in ".!?…" and not (closed and nxt in "“„«「『（(¿¡"):
            # no blank behind a Latin mark: a decimal, an address, or marks between ideographs
            if last in "!?" and not nxt.isascii() and not LATIN.match(nxt) and nxt.isalpha() and not closed and not nxt.isupper() and not nxt.islower():
                return end
            return 0
        if nxt in ",;:、，；：،؛" or (nxt in ")）]" and not closed):
            return 0
        if nxt in "-–—":
            k = j
            while k < n and (part[k] in "-–—" or part[k].isspace()):
                k += 1
            if closed or (k < n and part[k].islower()):
                return 0
            return end
        letter = nxt.isalpha() or nxt.isdigit()
        caseless = nxt.isalpha() and not nxt.isupper() and not nxt.islower()
        opener = not letter
        if pause:
            if nxt.islower() or caseless or lower_style:
                return 0
            return end
        if last in "。｡।॥．":
            return end
        if last != "." or len(run) > 1:  # question or exclamation
            if not closed:
                if nxt.islower() and not lower_style:
                    return 0
                return end
            if nxt.islower() or caseless:
                return 0
            if nxt.isupper() and self._shouted(part, m.start(), j):
                return 0
            return end
        # one period
        before = _before(part, start, m.start())
        if closed:
            if nxt.islower() and not lower_style:
                return 0
            if before and not nxt.islower() and part[i] in ")]" and _plain(before) in self.abbr and part.rfind("(", start, i) > start + 1 and not self._opens(part, start, i):
                return 0
            return end
        if nxt.islower() and not lower_style:
            return 0
        if not before:
            if "ऀ" <= part[m.start() - 1 : m.start()] <= "෿":
                return 0  # scripts with a danda use the period for abbreviations
            return end
        if before[0].isdigit():
            if nxt.isupper() or lower_style:
                w = WORD.match(part, j)
                if w and _plain(w.group()) in self.after:
                    return 0
            return end
        if _plain(before) in self.number and not opener:
            w = WORD.match(part, j)  # a type that stands before numbers: an abbreviation there, unless a sentence starts behind it
            if nxt.isdigit() or (w and _plain(w.group()) not in self.starters):
                return 0
        return self._after_word(part, before, j, nxt, end, lower_style, caseless, opener)

    @staticmethod
    def _opens(part, start, i):
        """Whether the bracket that closes at i opened at the start of the sentence."""
        return part[start:i].lstrip()[:1] in "([（"

    @staticmethod
    def _shouted(part, i, j):
        """Capitals on both sides carry no case."""
        k = i
        while k > 0 and not (part[k - 1].isalnum() or part[k - 1] == "_"):
            k -= 1
        left, right = re.search(r"([^\W\d_]{2,})$", _before(part, 0, k)), WORD.match(part, j)
        return bool(left and right and left.group(1).isupper() and right.group().isupper() and len(right.group()) > 1)

    def _after_word(self, part, before, j, nxt, end, lower_style, caseless, opener):
        kind = _plain(before)
        known = kind in self.abbr
        if not known and "ऀ" <= before[-1] <= "෿":
            return 0
        single = len(before) == 1
        dotted = "." in before
        if not (known or single or dotted):
            return end
        ends = self.abbr.get(kind)
        if single and not known and before.isupper() and nxt.isupper() and not LATIN.match(before) is None:
            return 0
        if nxt.isdigit() or caseless:
            return 0
        w = WORD.match(part, j)
        follows = _plain(w.group()) if w else ""
        if lower_style and nxt.islower():
            return end if (ends or 0) >= 0.25 and follows in self.starters else 0
        if opener:
            return end if (ends or 0) >= 0.25 else 0
        if ends is None:
            return end if follows in self.starters and not (single and before.isupper()) else 0
        return end if ends >= 0.25 else 0


def _split_batches(model: Model):
    def run(batches):
        splitters: dict = {}
        for batch in batches:
            starts, ends, off = [], [], [0]
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text:
                    if not lang or lang not in model.frequent:
                        lang = guess_language(text, model.frequent) or POOL
                    if lang not in splitters:
                        splitters[lang] = Splitter(model, lang)
                    for a, b in splitters[lang].spans(text):
                        starts.append(a)
                        ends.append(b)
                off.append(len(starts))
            off = pa.array(np.array(off, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.ListArray.from_arrays(off, pa.array(starts, pa.int32())), pa.ListArray.from_arrays(off, pa.array(ends, pa.int32()))], ["id", "at", "starts", "ends"])

    return run


def split(df: DataFrame, key: str = "id", text: str = "text", lang: str = "lang", when: str = "loaded_at", model: Model | None = None) -> DataFrame:
    """(id, start_pos, end_pos): the sentences of each distinct id, of its last delivery.

    A null key gives no rows. Languages the model doesn't know, and null, are
    guessed from the text. Only ids and offsets are shuffled, not texts.
    """
    model = model or learn(df, text, lang)
    at = F.col(when).cast("timestamp") if when in df.columns else F.lit(None).cast("timestamp")
    src = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.unix_micros(at), F.lit(0)).alias("at"))
    rows = src.mapInArrow(_split_batches(model), "id string, at long, starts array<int>, ends array<int>")
    one = rows.groupBy("id").agg(F.max_by(F.struct("starts", "ends"), "at").alias("s"))
    return one.select("id", F.explode(F.arrays_zip("s.starts", "s.ends")).alias("x")).select("id", F.col("x.starts").alias("start_pos"), F.col("x.ends").alias("end_pos"))
