"""Problem 7: token ids of a public byte-level BPE tokenizer for a whole corpus.

Words are cut off by the tokenizer's own pattern. Those that make up most of
the corpus are compiled, with their ids, into a minimal acyclic transducer: an
automaton whose equal suffixes are shared, in which the number of a word is
the sum of the counts skipped on its way, and points to its ids. It is written
once, sent to every executor as a file and memory-mapped there. Words that it
does not hold are merged exactly by their pair ranks.
"""

from __future__ import annotations

import base64
import functools
import heapq
import io
import itertools
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_dir, cut
from . import codepoints as cp

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's pattern, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that make up at least this share of all words get into the lexicon: at most 1 / LEAST_SHARE of them.
LEAST_SHARE = 5e-6
CACHE = 100_000


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the pair of least rank is merged, leftmost first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n < 40:
        parts = [word[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    # long words: the pairs in a heap, parts as a linked list by start
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray([1]) * n
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or after[i] != j or j >= n or not alive[j] or end[j] != stop:
            continue
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            k = after[i]
            if (r := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Lexicon:
    """A minimal acyclic transducer from words (bytes) to ids, in four arrays."""

    def __init__(self, keys, targets, skips, final, starts, ids):
        self.keys, self.targets, self.skips, self.final, self.starts, self.ids = keys, targets, skips, final, starts, ids

    @classmethod
    def compile(cls, words: list[bytes], outputs: list[list[int]]) -> "Lexicon":
        """From sorted, distinct words. Each state is kept once per set of its suffixes."""
        register: dict[tuple, int] = {}
        counts, edges = [], []  # by state
        path: list[list] = [[False, []]]  # the last word's states that may still change: [final, [(byte, state)]]

        def freeze(depth):
            while len(path) > depth + 1:
                last, arcs = path.pop()
                sig = (last, tuple(arcs))
                state = register.get(sig)
                if state is None:
                    state = register[sig] = len(counts)
                    counts.append(int(last) + sum(counts[s] for _, s in arcs))
                    edges.append((last, arcs))
                path[-1][1].append((opened.pop(), state))

        opened: list[int] = []
        previous = b""
        for w in words:
            common = 0
            while common < min(len(w), len(previous)) and w[common] == previous[common]:
                common += 1
            freeze(common)
            for b in w[common:]:
                opened.append(b)
                path.append([False, []])
            path[-1][0] = True
            previous = w
        freeze(0)
        root = len(counts)
        counts.append(int(path[0][0]) + sum(counts[s] for _, s in path[0][1]))
        edges.append(tuple(path[0]))
        keys, targets, skips = [], [], []
        final = np.zeros(len(edges), np.uint8)
        for state, (last, arcs) in enumerate(edges):
            s = root - state  # the root becomes state 0
            final[s] = last
            skip = int(last)
            for b, to in arcs:
                keys.append(s << 8 | b)
                targets.append(root - to)
                skips.append(skip)
                skip += counts[to]
        order = np.argsort(np.array(keys, np.uint64)) if keys else np.empty(0, int)
        take = lambda x, kind: np.array(x, kind)[order]
        flat = np.array([i for o in outputs for i in o], np.int32)
        starts = np.concatenate(([0], np.cumsum([len(o) for o in outputs]))).astype(np.int64)
        return cls(take(keys, np.uint64), take(targets, np.uint32), take(skips, np.uint32), final, starts, flat)

    def save(self) -> bytes:
        """A header of lengths and the arrays, each at a multiple of 8 bytes."""
        out, head, body = io.BytesIO(), [], b""
        for a in (self.keys, self.targets, self.skips, self.final, self.starts, self.ids):
            head.append(a.nbytes)
            body += a.tobytes() + b"\0" * (-a.nbytes % 8)
        out.write(np.array(head, np.int64).tobytes())
        out.write(body)
        return out.getvalue()

    @classmethod
    def map(cls, path: str) -> "Lexicon":
        raw = np.memmap(path, np.uint8, "r")
        head, at, arrays = raw[:48].view(np.int64), 48, []
        for size, kind in zip(head, (np.uint64, np.uint32, np.uint32, np.uint8, np.int64, np.int32)):
            arrays.append(raw[at : at + int(size)].view(kind))
            at += int(size) + (-int(size) % 8)
        return cls(*arrays)

    def find(self, words: list[bytes]) -> list:
        """The ids of each word, or None: all words walk the automaton together, a byte at a time."""
        n = len(words)
        out: list = [None] * n
        if not len(self.keys) or not n:
            return out
        lens = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(lens) - lens
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(lens > 0)
        done: list[np.ndarray] = []
        step = 0
        while len(live):
            key = state[live].astype(np.uint64) << np.uint64(8) | data[at[live] + step].astype(np.uint64)
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[pos] == key
            live, pos = live[ok], pos[ok]
            state[live] = self.targets[pos]
            number[live] += self.skips[pos]
            step += 1
            over = lens[live] == step
            done.append(live[over])
            live = live[~over]
        for i in np.concatenate(done) if done else ():
            if self.final[state[i]]:
                k = number[i]
                out[i] = self.ids[self.starts[k] : self.starts[k + 1]].tolist()
        return out


#: The white space of the tokenizer's pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _members(kind: str) -> str:
    """The characters below U+10000 of a Unicode property, as ranges of a character class."""
    import regex

    return "".join(re.escape(m[0]) if len(m[0]) == 1 else f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(rf"\p{{{kind}}}+", "".join(map(chr, range(0xD800)))))


@functools.lru_cache(maxsize=1)
def word_cutter():
    """A function that cuts a text into words by PATTERN.

    Texts whose characters all lie below U+D800 go through an equal pattern
    with explicit character classes, which takes less time; all others through
    the pattern as it is.
    """
    import regex

    def plain(letter, number):
        return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

    ascii_words, low_words, any_words = plain("A-Za-z", "0-9"), plain(_members("L"), _members("N")), regex.compile(PATTERN).findall
    high = re.compile("[\ud800-\U0010ffff]").search

    def words(text: str) -> list[str]:
        if text.isascii():
            return ascii_words(text)
        return any_words(text) if high(text) else low_words(text)

    return words


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


class Encoder:
    """Encodes texts; holds the lexicon, the ranks and a bounded cache of words with their ids."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon | None = None):
        self.ranks, self.lexicon, self.words = ranks, lexicon, word_cutter()
        self._clear()

    def _clear(self):
        self.numbers = _Numbers()
        self.starts, self.lens, self.chars, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self):
        """Looks up the ids of the words that were numbered since the last call."""
        known = len(self.lens)
        if len(self.numbers) == known:
            return
        new = list(itertools.islice(self.numbers, known, None))
        raw = [w.encode("utf-8") for w in new]
        found = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        ids = [f if f is not None else merge(r, self.ranks) for r, f in zip(raw, found)]
        lens = np.array([len(i) for i in ids], np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lens) - lens))
        self.lens = np.concatenate((self.lens, lens))
        self.chars = np.concatenate((self.chars, np.array([len(w) for w in new], np.int64)))
        self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lens.sum()))))

    def cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, where each text's words start); the words' ids are known afterwards."""
        if len(self.numbers) > CACHE:
            self._clear()
        of, lens = [np.empty(0, np.int64)], []
        for lo in range(0, len(texts), 128):  # few at a time, while their words lie in the processor's cache
            words = [self.words(t) if t else () for t in texts[lo : lo + 128]]
            lens += map(len, words)
            of.append(np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(words)), np.int64))
        self._learn()
        return np.concatenate(of), np.concatenate(([0], np.cumsum(lens, dtype=np.int64))).astype(np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        of, off = self.cut(texts)
        total = np.concatenate(([0], np.cumsum(self.lens[of])))[off]
        return np.diff(total)

    def arrays(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one behind the other, and where each text's start."""
        of, off = self.cut(texts)
        return self.ids_of(of), np.concatenate(([0], np.cumsum(self.lens[of])))[off]

    def batch(self, texts: list[str | None]) -> list[list[int]]:
        ids, off = self.arrays(texts)
        return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]

    def __call__(self, text: str) -> list[int]:
        return self.batch([text])[0]

    def ids_of(self, of: np.ndarray) -> np.ndarray:
        """The ids of numbered words one behind the other."""
        word, place = cp.expand(self.lens[of])
        return self.flat[self.starts[of][word] + place]


def _count_words(batches):
    words, c = word_cutter(), Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8") for w in c], pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        c.update(itertools.chain.from_iterable(words(t) for t in batch.column(0).to_pylist() if t))
        if len(c) > 500_000:
            yield rows()
            c.clear()
    yield rows()


def frequent_words(texts: DataFrame, least_share: float = LEAST_SHARE) -> list[bytes]:
    """The words that make up least_share of all words, counted once over all rows; at most 1 / least_share of them."""
    c = cut(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = c.agg(F.sum("n")).first()[0] or 0
    rows = c.where(F.col("n") >= F.lit(max(2.0, least_share * total))).select("word").collect()
    return sorted(bytes(r[0]) for r in rows)


def publish(spark: SparkSession, lexicon: Lexicon) -> str:
    """Writes the lexicon to the checkpoint folder and has every executor fetch it; returns its file name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark), name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(path, True)
    stream.write(bytearray(lexicon.save()))
    stream.close()
    fs.deleteOnExit(path)  # tasks may fetch it as long as the session lives
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


class Tokenizer:
    """What the tasks need: the ranks (of fixed size) and the name of the lexicon's file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, texts: DataFrame, path: str = RANKS, least_share: float = LEAST_SHARE):
        ranks = read_ranks(path)
        spark = texts.sparkSession
        words = frequent_words(texts, least_share)
        self.name = publish(spark, Lexicon.compile(words, [merge(w, ranks) for w in words]))
        self.ranks = spark.sparkContext.broadcast(ranks)  # the vocabulary, whatever the corpus

    def encoder(self) -> Encoder:
        """The encoder of this worker process."""
        if self.name not in Tokenizer._made:
            Tokenizer._made.clear()
            Tokenizer._made[self.name] = Encoder(self.ranks.value, Lexicon.map(SparkFiles.get(self.name)))
        return Tokenizer._made[self.name]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """(key, ids): the token ids of every row, without special tokens.

    Strings that look like special tokens are ordinary text; a null and an
    empty text have an empty list; rows are kept as they are, repeated or with
    a null key.
    """
    tok = Tokenizer(df.select(F.col(text).alias("text")), path)

    def run(batches):
        enc = tok.encoder()
        for batch in batches:
            ids, off = enc.arrays(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))], [key, "ids"])

    src = df.select(key, F.col(text).alias("text"))
    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = RANKS) -> DataFrame:
    """The kept columns with n_tokens; 0 for null and empty texts."""
    tok = Tokenizer(df.select(F.col(text).alias("text")), path)
    src = df.select(*keep, F.col(text).alias("_text_"))

    def run(batches):
        enc = tok.encoder()
        for batch in batches:
            n = pa.array(enc.count(batch.column(len(keep)).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], [*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{fields}, n_tokens long")
