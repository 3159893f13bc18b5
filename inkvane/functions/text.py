"""Sentences and words as native columns, and tables of them. No shuffle.

Offsets are code points, end exclusive. A text that is null gives null arrays;
a blank text gives empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordlists import ABBREVIATIONS

#: White space as the data model has it: Unicode blanks and the four separators U+001C to U+001F.
SPACE = r"\t-\r\x1c-\x1f \x85\xa0  -     　"
CLOSERS = r"\"'）)\]”’»"
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)*|\p{Nd}+(?:[.,]\p{Nd}+)*"
#: Marks put into the text to split it: a sentence end, the start and the end of a paragraph break.
END, OPEN, CLOSE = "", "", ""

#: Before a lone period: an abbreviation or a single letter.
_SHORT = r"(?<!(?<![A-Za-z'])'{0,16}(?:[A-Za-z]|(?i:" + "|".join(ABBREVIATIONS) + r"))\.)"
#: The first mark of a run; then more marks, or a lone mark that is no period, or a period after no abbreviation; then closing signs and what must follow.
_BOUNDARY = rf"[.!?](?<![.!?][.!?])(?:[.!?]++|(?<=[!?])|{_SHORT})[{CLOSERS}]*+(?=[{SPACE}{OPEN}]|\z)"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def sentences(text: Column) -> Column:
    """array<struct<sid, start, end, text>> of a text's sentences, trimmed; blank pieces are left out.

    Paragraph breaks (a line end, blanks, line ends) always end a sentence. A
    run of . ! ? and the closing signs behind it ends one if white space or the
    paragraph's end follows; a single period does not after an abbreviation or
    a single letter. The text may hold the private marks; they are looked
    through.
    """
    safe = F.translate(text, END + OPEN + CLOSE, "���")
    marked = F.regexp_replace(F.regexp_replace(safe, r"(\n[ \t]*\n+)", f"{OPEN}$1{CLOSE}"), _BOUNDARY, f"$0{END}")
    pieces = F.split(marked, f"[{END}{CLOSE}]")
    parts = F.transform(pieces, lambda p: F.struct(F.substring_index(p, OPEN, 1).alias("body"), (F.length(p) - F.when(F.contains(p, F.lit(OPEN)), 1).otherwise(0)).alias("len")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<body:string,at:int>>").alias("out"))
    placed = F.aggregate(parts, start, lambda acc, p: F.struct(
        (acc["at"] + p["len"]).cast("int").alias("at"),
        F.when(F.regexp_like(p["body"], F.lit(rf"[^{SPACE}]")), F.concat(acc["out"], F.array(F.struct(p["body"].alias("body"), acc["at"].alias("at"))))).otherwise(acc["out"]).alias("out"),
    ), lambda acc: acc["out"])

    def trimmed(s, i):
        left = F.regexp_replace(s["body"], rf"^[{SPACE}]+", "")
        at = s["at"] + F.length(s["body"]) - F.length(left)
        end = at + F.length(F.regexp_replace(left, rf"[{SPACE}]+\z", ""))
        return F.struct(i.alias("sid"), at.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(text, at + 1, end - at).alias("text"))

    return F.transform(placed, trimmed)


def words(text: Column) -> Column:
    """array<string> of the words and numbers of a text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def paragraphs(text: Column) -> Column:
    """array<string> of the parts between paragraph breaks that are not blank."""
    return F.filter(F.split(text, r"\n[ \t]*\n+"), lambda p: F.regexp_like(p, F.lit(rf"[^{SPACE}]")))


def explode_sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sid, start, end, sentence) of every sentence."""
    from . import batch

    one = df.select(F.col(key), F.explode(batch.sentences(F.col(text))).alias("s"))
    return one.select(key, "s.sid", "s.start", "s.end", F.col("s.text").alias("sentence"))


def explode_words(df: DataFrame, key: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """(key, sid, pos, word, start, end): words of every sentence; no word crosses a sentence's end. Without offsets, start and end are left out."""
    from . import batch

    return batch.explode_words(df, key, text, offsets)
