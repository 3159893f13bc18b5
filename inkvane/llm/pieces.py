"""Problem 9: texts over a token limit cut into balanced, overlapping pieces at natural boundaries."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sentences, tokens

PARAGRAPH, SENTENCE, WORD, TOKEN = 4, 3, 2, 1
_SPACE = re.compile(r"\s")
_PLAIN = sentences.Splitter(sentences.Model({}, {}, {}, {}, {}), None)


def widths(ranks: dict[bytes, int]) -> np.ndarray:
    """Bytes of each token."""
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    out[list(ranks.values())] = [len(b) for b in ranks]
    return out


@functools.lru_cache(maxsize=1)
def _blanks() -> np.ndarray:
    """White space by code point."""
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x10000) if chr(c).isspace()]] = True
    return out


def boundaries(text: str, enc: tokens.Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, tokens before it, strength, whether a word of the tokenizer ends there) of every place between tokens that is also one between characters."""
    of, _ = enc.cut([text])
    raw, signs = np.frombuffer(text.encode("utf-8"), np.uint8), np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.append((raw & 0xC0) != 0x80, True)  # bytes that begin a character, and the end
    ends = np.cumsum(np.concatenate(([0], enc.width[enc.ids_of(of)])))  # bytes before each token
    before = np.flatnonzero(first[ends])
    place = (np.cumsum(first) - 1)[ends[before]]
    whole = np.zeros(len(signs) + 1, bool)
    whole[np.cumsum(np.concatenate(([0], enc.chars[of])))] = True
    blank = np.concatenate(([False], _blanks()[signs], [False]))
    strength = np.where(whole & (blank[1:] | blank[:-1]), WORD, TOKEN)  # by place: white space on either side of a word's end
    strength[[0, -1]] = PARAGRAPH, TOKEN
    strength, whole = strength[place], whole[place]
    strength[np.isin(place, [b for _, b in _PLAIN.spans(text)])] = SENTENCE
    strength[np.isin(place, [m.start() for m in sentences.BLANK_LINE.finditer(text)])] = PARAGRAPH
    return place, before, strength, whole


def cut_points(place, before, strength, most: int, overlap: int, pieces: int) -> list[tuple[int, int]] | None:
    """(start, end) as indexes into the boundaries for the given number of pieces, or None if a limit fails.

    The ends are set at equal distances and snapped to the strongest boundary
    within half of the room that is left on either side, nearest first. Where
    that would be inside a word, the nearest other boundary that the limits
    allow is taken, and the ends left are set at equal distances anew. A piece
    starts at the last boundary with at least `overlap` tokens before the end
    of the one before it.
    """
    n = int(before[-1])
    step = (n - overlap) / pieces
    room = max(0.0, (most - overlap - step) / 2)
    out, start, base, done = [], 0, overlap, 0
    for i in range(1, pieces + 1):
        if i == pieces:
            end = len(place) - 1
        else:
            goal = base + (i - done) * step
            lo, hi = np.searchsorted(before, goal - room, "left"), np.searchsorted(before, goal + room, "right")
            if lo >= hi:
                lo = max(0, int(np.searchsorted(before, goal, "right")) - 1)
                hi = lo + 1
            near = np.arange(lo, hi)
            best = near[np.lexsort((np.abs(before[near] - goal), -strength[near]))[0]]
            if strength[best] == TOKEN:
                lo = np.searchsorted(before, max(n - (pieces - i) * (most - overlap), before[start] + overlap + 1), "left")
                far = np.arange(lo, np.searchsorted(before, before[start] + most, "right"))
                far = far[strength[far] > TOKEN]
                if len(far):
                    best = far[np.lexsort((-strength[far], np.abs(before[far] - goal)))[0]]
                    base, done, step = int(before[best]), i, (n - int(before[best])) / (pieces - i)
                    room = max(0.0, (most - overlap - step) / 2)
            end = int(best)
        if end <= start or before[end] - before[start] > most:
            return None
        out.append((start, end))
        nxt = int(np.searchsorted(before, before[end] - overlap, "right")) - 1
        if i < pieces and (nxt <= start or nxt >= end and overlap > 0):
            return None
        start = nxt if overlap else end
    return out


def cut_text(text: str, enc: tokens.Encoder, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, strength of the cut behind it) of each piece; [] for a text within the limit.

    The number of pieces is the least that can hold the text, and a sixteenth
    more so that long texts too have room for natural boundaries. More are
    tried, in proportion, while a piece on its own has more than `most` tokens
    or a cut falls inside a word although its piece has a word's end. A single character of
    more than `most` tokens is a piece of its own.
    """
    if not text:
        return []
    place, before, strength, whole = boundaries(text, enc)
    n = int(before[-1])
    if n <= most:
        return []
    known: dict[tuple[int, int], int] = {}

    def size(a, b):
        """Tokens of a piece on its own: those of its words, and only a piece that starts or ends inside a word is encoded."""
        if whole[a] and whole[b]:
            return int(before[b] - before[a])
        if (a, b) not in known:
            known[a, b] = int(enc.count([text[place[a] : place[b]]])[0])
        return known[a, b]

    overlap = max(0, min(overlap, most - 1))
    least = -(-(n - overlap) // (most - overlap))
    words = before[strength > TOKEN]
    best, nxt = None, least + least // 16
    while nxt < 4 * least + 16:
        pieces, nxt = nxt, nxt + 1 + nxt // 16
        cuts = cut_points(place, before, strength, most, overlap, pieces)
        if cuts is None:
            continue
        sizes = [size(a, b) for a, b in cuts]
        if max(sizes) > most:
            continue
        got = [(int(place[a]), int(place[b]), s, int(strength[b])) for (a, b), s in zip(cuts, sizes)]
        weak = sum(strength[b] == TOKEN and np.searchsorted(words, before[b], "right") > np.searchsorted(words, before[a] + overlap, "right") for a, b in cuts[:-1])
        if best is None or weak < best[0]:
            best = (weak, got)
        if not weak:
            break
    if best is not None:
        return best[1]
    return _fill(text, enc, most, overlap)


def _fill(text: str, enc: tokens.Encoder, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Where no even layout holds the limit (limits of a few tokens): filled up piece by piece, cut between any characters."""
    out, start = [], 0
    while True:
        low, high = start + 1, min(len(text), start + 2)
        while high < len(text) and len(enc(text[start:high])) <= most:
            low, high = high, min(len(text), start + 2 * (high - start))
        if len(enc(text[start:high])) <= most:
            low = high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if len(enc(text[start:mid])) <= most else (low, mid)
        while low > start + 1 and len(enc(text[start:low])) > most:
            low -= 1
        out.append((start, low, len(enc(text[start:low])), TOKEN if low < len(text) else PARAGRAPH))
        if low == len(text):
            return out
        back = low
        while overlap and back > start + 1 and len(enc(text[back:low])) < overlap:
            back -= 1
        start = back if overlap and back > start else low


def split(df: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", path: str = tokens.RANKS) -> DataFrame:
    """(key, piece_no, start_pos, end_pos, n_tokens, cut, piece): the pieces of every text over the limit.

    Positions are code points, piece_no counts from 0, cut is the strength of
    the boundary at the piece's end (4 paragraph or text end, 3 sentence,
    2 word, 1 other). Null, empty and short texts give no rows; repeated keys
    are cut row by row.
    """
    row = limits.select(F.max("max_tokens"), F.max("overlap_tokens")).first()
    most, overlap = int(row[0] or 0), int(row[1] or 0)
    src = df.select(key, F.col(text).alias("_text_"))
    fields = f"`{key}` {src.schema[key].dataType.simpleString()}, piece_no int, start_pos int, end_pos int, n_tokens int, cut int, piece string"
    if most < 1:
        return df.sparkSession.createDataFrame([], fields)
    tok = tokens.Tokenizer(src.select("_text_"), path)

    def run(batches):
        enc = tok.encoder()
        if not hasattr(enc, "width"):
            enc.width = widths(enc.ranks)
        for batch in batches:
            keys, rows, texts = [], [], batch.column(1).to_pylist()
            for k in np.flatnonzero(enc.count(texts) > most).tolist():
                t = texts[k]
                for i, (a, b, n, s) in enumerate(cut_text(t, enc, most, overlap)):
                    keys.append(k)
                    rows.append((i, a, b, n, s, t[a:b]))
            cols = list(zip(*rows)) or [()] * 6
            ints = [pa.array(c, pa.int32()) for c in cols[:5]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *ints, pa.array(cols[5], pa.string())], [key, "piece_no", "start_pos", "end_pos", "n_tokens", "cut", "piece"])

    return src.mapInArrow(run, fields)
