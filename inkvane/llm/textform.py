"""One form for texts that read the same but are stored as different characters.

All work is done on the code points of a whole Arrow batch: lookup-table
gathers, expansion offsets for characters that decompose, vector rounds that
put combining marks in order and compose them. No string call is made per row.

The form
  * drops signs that cannot be seen (zero-width signs, soft hyphen, BOM, bidi
    and variation marks, control characters other than line ends),
  * makes every blank U+0020, and every line end U+000A,
  * undoes width, ligature and presentation forms, look-alike radicals and
    hyphens, and stores accents composed wherever Unicode has a composed sign,
  * gives look-alike Latin, Cyrillic and Greek letters the script of their
    word (that of the text where the word alone does not tell).
Letter case, digits, accents and all visible signs stay as they are.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

from . import codepoints as cp

LIMIT = 0x110000
#: Compatibility mappings that change only width, joining or place of a sign.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>", "<font>"}
#: Letters of other scripts drawn like a Latin one.
CYRILLIC_TWINS = dict(zip("аеорсухіѕјһԁԛԝАВЕКМНОРСТХУІЅЈԌ", "aeopcyxisjhdqwABEKMHOPCTXYISJG"))
GREEK_TWINS = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX"))
HYPHENS = "‐‑﹣－"
LATIN, CYRILLIC, GREEK = 1, 2, 3
THAI_TONES = range(0x0E48, 0x0E4C)
NIKHAHIT, SARA_AA, SARA_AM = 0x0E4D, 0x0E32, 0x0E33
#: First code point and number of leading, vowel and trailing jamo, and the first syllable.
LEAD, LEADS, VOWEL, VOWELS, TRAIL, TRAILS, SYLLABLE = 0x1100, 19, 0x1161, 21, 0x11A7, 28, 0xAC00
COMPATIBLE_JAMO = range(0x3131, 0x318F)


def _source_chars():
    """Code points that may have a decomposition, a class or a fold; leaves out unassigned and plain ideograph blocks."""
    for lo, hi in ((0x0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)):
        yield from range(lo, hi)


def _decompose(ch: str) -> str:
    if ord(ch) in COMPATIBLE_JAMO:  # letters shown singly, which must not join into syllables
        return ch
    spec = unicodedata.decomposition(ch)
    if not spec:
        return ch
    parts = spec.split()
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK:
            return ch
        parts = parts[1:]
        if parts[0] == "0020" and len(parts) > 1:  # a free-standing accent is no blank
            return ch
    return "".join(_decompose(chr(int(p, 16))) for p in parts)


class Tables:
    """Lookup tables by code point, built from the interpreter's Unicode data."""

    def _rest(self, c, more):
        return more[self.start[c] : self.start[c] + self.extra[c]]

    def __init__(self) -> None:
        self.first = np.arange(LIMIT, dtype=np.uint32)  # the one code point it becomes
        self.extra = np.zeros(LIMIT, np.uint8)  # how many more it becomes
        self.start = np.zeros(LIMIT, np.int32)
        more: list[int] = []
        self.ccc = np.zeros(LIMIT, np.uint8)
        self.drop = np.zeros(LIMIT, bool)
        self.cls = np.zeros(LIMIT, np.uint8)  # 1 letter, 2 mark, 3 decimal digit
        self.lower = np.arange(LIMIT, dtype=np.uint32)
        for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2A6E0), (0x2A700, 0x2EBE1), (0x30000, 0x323B0)):
            self.cls[lo:hi] = 1
        self.script = np.zeros(LIMIT, np.uint8)
        for c in _source_chars():
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Co", "Cs"):
                continue
            self.ccc[c] = unicodedata.combining(ch)
            self.cls[c] = 1 if cat[0] == "L" else 2 if cat[0] == "M" else 3 if cat == "Nd" else 0
            if cat == "Zs" or c == 0x9:
                self.first[c] = 0x20
                continue
            if cat == "Cf" or (cat == "Cc" and c not in (0xA, 0xD, 0xB, 0xC, 0x85)) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D):
                self.drop[c] = True
                continue
            d = _decompose(ch)
            if d != ch:
                self.first[c] = ord(d[0])
                if len(d) > 1:
                    self.extra[c], self.start[c] = len(d) - 1, len(more)
                    more += [ord(x) for x in d[1:]]
            low = ch.lower()
            if len(low) == 1:
                self.lower[c] = ord(low)
            if cat[0] == "L":
                name = unicodedata.name(ch, "")
                self.script[c] = LATIN if name.startswith("LATIN ") else CYRILLIC if name.startswith("CYRILLIC ") else GREEK if name.startswith("GREEK ") else 0
        for c in (0x2028, 0x2029, 0x85, 0xB, 0xC, 0xD):
            self.first[c] = 0xA
        for ch in HYPHENS:
            self.first[ord(ch)] = 0x2D
            self.extra[ord(ch)] = 0
        self.more = np.array(more or [0], np.uint32)
        pairs: dict[int, int] = {}
        for c in _source_chars():
            spec = unicodedata.decomposition(chr(c))
            if spec and spec[0] != "<" and " " in spec:
                a, b = (int(x, 16) for x in spec.split())
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(c):
                    pairs[a << 21 | b] = c
        pairs[NIKHAHIT << 21 | SARA_AA] = SARA_AM
        keys = np.array(sorted(pairs), np.uint64)
        self.pair_keys, self.pair_to = keys, np.array([pairs[int(k)] for k in keys], np.uint32)
        back = {c: k for k, c in pairs.items()}
        # signs that are already in the form unless a mark or another sign of this kind stands beside them
        self.trigger = (self.first != np.arange(LIMIT, dtype=np.uint32)) | (self.extra > 0) | self.drop | (self.ccc > 0)
        self.trigger[[c for c in back if self.extra[c] and c != SARA_AM and all(self.ccc[x] for x in self._rest(c, more))]] = False
        self.trigger[[NIKHAHIT, SARA_AA]] = [True, False]
        self.trigger[SARA_AM] = False
        self.second = np.zeros(LIMIT, bool)  # may be the second of a pair
        self.second[np.unique(keys & np.uint64(0x1FFFFF)).astype(np.int64)] = True
        self.trigger |= self.second & (np.arange(LIMIT) != SARA_AA)
        # a vowel or trailing jamo joins what stands before it; the syllables themselves need nothing
        self.trigger[VOWEL : VOWEL + VOWELS] = self.trigger[TRAIL + 1 : TRAIL + TRAILS] = True
        # look-alikes: to[script][c] is the twin of c in that script
        self.to = np.tile(np.arange(LIMIT, dtype=np.uint32), (4, 1))
        self.twin = np.zeros(LIMIT, bool)
        for script, table in ((CYRILLIC, CYRILLIC_TWINS), (GREEK, GREEK_TWINS)):
            for other, latin in table.items():
                self.to[LATIN][ord(other)] = ord(latin)
                self.to[script][ord(latin)] = ord(other)
                self.twin[[ord(other), ord(latin)]] = True
        for other, latin in CYRILLIC_TWINS.items():
            for greek, same in GREEK_TWINS.items():
                if same == latin:
                    self.to[GREEK][ord(other)] = ord(greek)
                    self.to[CYRILLIC][ord(greek)] = ord(other)
        self.over_twin = (self.extra > 0) & self.twin[self.first]  # composed letters whose base is a look-alike


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _line_ends(cps, off):
    """CR LF counts as one line end."""
    crlf = np.flatnonzero((cps[:-1] == 0xD) & (cps[1:] == 0xA)) if len(cps) > 1 else np.empty(0, int)
    if not len(crlf):
        return cps, off
    mask = np.ones(len(cps), bool)
    inner = np.zeros(len(cps) + 1, bool)
    inner[off] = True
    mask[crlf[~inner[crlf + 1]]] = False
    return cp.keep(cps, off, mask)


def _order_marks(cps, off, t):
    """Stable order of neighbouring combining marks by class, by exchange rounds over the few places out of order."""
    ccc = t.ccc[cps]
    if not ccc.any():
        return cps
    border = np.zeros(len(cps) + 1, bool)
    border[off] = True
    cps = cps.copy()
    while True:
        bad = np.flatnonzero((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0) & ~border[1:-1])
        if not len(bad):
            return cps
        bad = bad[np.concatenate(([True], np.diff(bad) > 1))]  # neighbours in turn
        for x in (cps, ccc):
            x[bad], x[bad + 1] = x[bad + 1], x[bad].copy()


def _thai(cps, off):
    """Nikhahit before tone marks goes behind them, as sara am is typed; in rounds, past one mark each."""
    border = None
    while True:
        at = np.flatnonzero((cps[:-1] == NIKHAHIT) & (cps[1:] >= THAI_TONES.start) & (cps[1:] < THAI_TONES.stop)) if len(cps) > 1 else np.empty(0, int)
        if len(at) and border is None:
            border = np.zeros(len(cps) + 1, bool)
            border[off] = True
            cps = cps.copy()
        at = at[~border[at + 1]] if len(at) else at
        if not len(at):
            return cps
        cps[at], cps[at + 1] = cps[at + 1], NIKHAHIT


def _hangul(cps, off):
    """Jamo that stand together become syllables, by arithmetic on whole arrays: lead and vowel, then syllable and trail."""
    for first, count, lo, many in ((LEAD, LEADS, VOWEL, VOWELS), (SYLLABLE, LEADS * VOWELS * TRAILS, TRAIL + 1, TRAILS - 1)):
        at = np.flatnonzero((cps[1:] >= lo) & (cps[1:] < lo + many)) + 1 if len(cps) > 1 else np.empty(0, int)
        if not len(at):
            continue
        border = np.zeros(len(cps) + 1, bool)
        border[off] = True
        base = cps[at - 1].astype(np.int64) - first
        ok = ~border[at] & (base >= 0) & (base < count)
        if first == SYLLABLE:
            ok &= base % TRAILS == 0  # a syllable holds one trail
        at, base = at[ok], base[ok]
        step = cps[at].astype(np.int64) - lo
        cps = cps.copy()
        cps[at - 1] = SYLLABLE + (base * VOWELS + step) * TRAILS if first == LEAD else SYLLABLE + base + step + 1
        mask = np.ones(len(cps), bool)
        mask[at] = False
        cps, off = cp.keep(cps, off, mask)
    return cps, off


def _compose(cps, off, t):
    """Joins a starter with following marks in rounds: each round joins at most one mark to a starter."""
    while True:
        n = len(cps)
        if n < 2:
            return cps, off
        cand = np.flatnonzero(t.second[cps[1:]]) + 1
        if not len(cand):
            return cps, off
        border = np.zeros(n + 1, bool)
        border[off] = True
        ccc = t.ccc[cps]
        # the starter before each candidate: walk back over marks of a lower class
        base = cand - 1
        ok = ~border[cand]
        while True:
            move = ok & (ccc[base] > 0) & (ccc[base] < ccc[cand]) & ~border[base] & (base > 0)
            if not move.any():
                break
            base = np.where(move, base - 1, base)
        ok &= ccc[base] == 0
        key = cps[base].astype(np.uint64) << np.uint64(21) | cps[cand].astype(np.uint64)
        pos = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        ok &= t.pair_keys[pos] == key
        if not ok.any():
            return cps, off
        cand, base, to = cand[ok], base[ok], t.pair_to[pos[ok]]
        _, one = np.unique(base, return_index=True)
        cps = cps.copy()
        cps[base[one]] = to[one]
        mask = np.ones(n, bool)
        mask[cand[one]] = False
        cps, off = cp.keep(cps, off, mask)


def _twins(cps, off, t):
    """Look-alike letters take the script of their word, or else of the text."""
    if not len(cps):
        return cps
    script, twin = t.script[cps], t.twin[cps]
    other = script >= CYRILLIC
    if not other.any():
        return cps
    rows = len(off) - 1
    row = cp.row_of(off)
    busy = np.bincount(row, weights=other, minlength=rows) > 0
    sure = (script > 0) & ~twin
    by_text = np.stack([np.bincount(row[sure & (script == s)], minlength=rows) for s in (LATIN, CYRILLIC, GREEK)])
    main = np.where(by_text.sum(0) > 0, by_text.argmax(0) + 1, 0).astype(np.uint8)
    part = ((t.cls[cps] == 1) | (t.cls[cps] == 2)) & busy[row]
    start = part.copy()
    start[1:] &= ~(part[:-1] & (row[1:] == row[:-1]))
    word = np.cumsum(start) - 1
    sel = np.flatnonzero(part)
    word = word[sel]
    words = int(word[-1]) + 1 if len(sel) else 0
    s = script[sel]
    count = np.stack([np.bincount(word[(s == k) & sure[sel]], minlength=words) for k in (LATIN, CYRILLIC, GREEK)])
    kinds = (count > 0).sum(0)
    own = main[row[np.flatnonzero(start)]]
    target = np.where(kinds == 1, count.argmax(0) + 1, own).astype(np.uint8)
    held = np.where(kinds > 1, np.where(own > 0, count[np.maximum(own, 1) - 1, np.arange(words)] > 0, False), True)
    target = np.where(held, target, 0)
    change = twin[sel] & (target[word] > 0)
    at = sel[change]
    cps = cps.copy()
    cps[at] = t.to[target[word[change]], cps[at]]
    return cps


def _full(cps, off, t):
    """The form of rows of which any sign may change."""
    gone = t.drop[cps]
    if gone.any():
        cps, off = cp.keep(cps, off, ~gone)
    extra = t.extra[cps]
    if extra.any():
        run, place = cp.expand(extra.astype(np.int64) + 1)
        src = cps[run]
        new = np.concatenate(([0], np.cumsum(extra.astype(np.int64) + 1)))
        cps = np.where(place == 0, t.first[src], t.more[np.where(place > 0, t.start[src] + place - 1, 0)])
        off = new[off]
    else:
        cps = t.first[cps]
    ordered = _order_marks(cps, off, t)
    cps = _thai(ordered, off)
    if cps is not ordered:  # a tone may now follow marks of a higher class
        cps = _order_marks(cps, off, t)
    return _compose(*_hangul(_twins(cps, off, t), off), t)


def _some_rows(cps, off, rows, fn):
    """fn over the marked rows, the others as they are."""
    if not rows.any():
        return cps, off
    if rows.all():
        return fn(cps, off)
    lens = np.diff(off)
    inside = np.repeat(rows, lens)
    new, new_off = fn(cps[inside], np.concatenate(([0], np.cumsum(lens[rows]))))
    lens = lens.copy()
    lens[rows] = np.diff(new_off)
    where = np.repeat(rows, lens)
    out = np.empty(int(lens.sum()), np.uint32)
    out[where], out[~where] = new, cps[~inside]
    return out, np.concatenate(([0], np.cumsum(lens)))


def _has(mask, off):
    """Rows with a true place."""
    at = np.flatnonzero(mask)
    rows = np.zeros(len(off) - 1, bool)
    rows[np.searchsorted(off, at, side="right") - 1] = True
    return rows


def form(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of every row, as code points and offsets."""
    t = tables()
    cps, off = _line_ends(cps, off)
    full = _has(t.trigger[cps], off)
    mixed = _has((cps >= 0x370) & (cps < 0x530), off) & ~full  # Greek or Cyrillic, nothing else to do
    if mixed.any():
        apart = mixed & _has(t.over_twin[cps], off)  # look-alikes under an accent show only when taken apart
        full, mixed = full | apart, mixed & ~apart
    if full.any():
        cps, off = _some_rows(cps, off, full, lambda c, o: _full(c, o, t))
    return _some_rows(cps, off, mixed, lambda c, o: (_twins(c, o, t), o))


def compared(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form in lower case, with letters, combining marks and decimal digits only."""
    t = tables()
    cps, off = form(cps, off)
    special = cps == 0x130  # the one letter whose lower case is two signs
    if special.any():
        run, place = cp.expand(1 + special.astype(np.int64))
        off = np.concatenate(([0], np.cumsum(1 + special.astype(np.int64))))[off]
        cps = np.where(special[run], np.where(place == 0, 0x69, 0x307), cps[run]).astype(np.uint32)
    cps, off = cp.keep(cps, off, t.cls[cps] > 0)
    return t.lower[cps], off


def form_column(col) -> pa.Array:
    """Arrow column of texts -> Arrow column of their forms; null stays null, empty stays empty."""
    cps, off, valid = cp.decode(col)
    return cp.encode(*form(cps, off), valid)
