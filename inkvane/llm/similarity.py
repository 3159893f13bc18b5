"""Problem 1: pairs of texts that share most of their 8-character runs.

Similarity is the Jaccard index of the sets of distinct runs of 8 adjacent
characters of the compared form (textform.compared).

1. Every text is reduced to min-wise samples of its runs and from these to
   BANDS super-runs, each standing for SPAN of its runs at once. Two texts of
   similarity s share a super-run with probability s**SPAN, so texts at the
   threshold share about BANDS * threshold**SPAN of them, and texts that only
   have stock phrases in common share none.
2. Super-runs are shuffled as packed arrays (about 6 bytes each), not as rows.
   A tile holds the super-runs of one key range; in it, texts with an equal
   super-run and sizes in bands near enough for the threshold meet.
   Exact copies are one text there, so copies cost nothing.
3. Pairs met in at least MEETINGS tiles get their texts; hashed bitmap
   signatures bound the overlap from above by bit counts, and what may still
   reach the threshold is decided by exact intersection of sorted arrays.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, shuffle_partitions
from . import codepoints as cp
from . import textform, units

RUN = 8
SHORTEST = 60
THRESHOLD = 0.5
SPAN = 4
BANDS = 112
MEETINGS = 2
PERMUTATIONS, BINS = 8, 16
KEY_BITS = 35
BITMAP_BITS = 2048
FLUSH = 2_000_000
#: Bytes of text files whose super-runs, some three times as many bytes, make one tile partition; and the most partitions.
TILE_BYTES, MOST_TILES = 1 << 25, 20_000
FILLER = 0xFFFFFFFF


@functools.lru_cache(maxsize=1)
def _constants():
    rng = np.random.Generator(np.random.PCG64(20240607))
    odd = rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64)
    picks = np.stack([rng.permutation(PERMUTATIONS * BINS)[:SPAN] for _ in range(BANDS)])
    salt = rng.integers(0, 2**63, (SPAN, 1), dtype=np.uint64) | np.uint64(1)
    probes = rng.integers(0, BINS, (64, BINS))
    return odd, add, picks, salt, probes


def run_hashes(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every run of RUN characters that lies within a row."""
    n = len(cps) - RUN + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = cps.astype(np.uint64)
    base, step = 0x9E3779B97F4A7C15, 1
    while step < RUN:  # runs of 2, 4, 8 characters
        h = h[:-step] * np.uint64(pow(base, step, 2**64)) + h[step:]
        step *= 2
    lens = np.maximum(np.diff(off) - RUN + 1, 0)
    row, place = cp.expand(lens)
    return row, cp.mix(h[off[row] + place])


def distinct_runs(cps, off):
    """The distinct runs of each row by row, then hash (48 bits): (row, row << 48 | hash, offsets). At most 65,536 rows."""
    row, h = run_hashes(cps, off)
    rows = len(off) - 1
    x = np.sort(row.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16))
    if len(x):
        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
    row = (x >> np.uint64(48)).astype(np.int64)
    return row, x, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))


def size_band(n: np.ndarray) -> np.ndarray:
    """Half octaves of the number of distinct runs, 0 to 15; sizes within a factor of 2 are at most 2 bands apart."""
    return np.clip(2 * np.log2(np.maximum(n, 1) / (SHORTEST - RUN + 1)), 0, 15).astype(np.uint32)


def _mins(cps, off):
    """Min-wise samples (rows x PERMUTATIONS*BINS, uint32) and the number of distinct runs."""
    odd, add, _, _, probes = _constants()
    rows = len(off) - 1
    row, h = run_hashes(cps, off)
    base = np.sort(row.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
    if len(base):
        base = base[np.concatenate(([True], base[1:] != base[:-1]))]
    row, h = base & np.uint64(0xFFFFFFFF00000000), base & np.uint64(0xFFFFFFFF)
    size = np.bincount((row >> np.uint64(32)).astype(np.int64), minlength=rows)
    out = np.empty((rows, PERMUTATIONS, BINS), np.uint32)
    for p in range(PERMUTATIONS):
        v = (h * odd[p] + add[p]) & np.uint64(0xFFFFFFFF)
        v ^= v >> np.uint64(15)
        v = (v * np.uint64(0x2C1B3C6D)) & np.uint64(0xFFFFFFFF)
        v ^= v >> np.uint64(12)
        x = np.sort(row | v)
        cell = x >> np.uint64(28)
        first = np.ones(len(x), bool)
        first[1:] = cell[1:] != cell[:-1]
        cell, x = cell[first].astype(np.int64), (x[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        table, full = np.zeros(rows * BINS, np.uint32), np.zeros(rows * BINS, bool)
        table[cell], full[cell] = x, True
        table, full = table.reshape(rows, BINS), full.reshape(rows, BINS)
        have = full.copy()
        for probe in probes:  # an empty bin takes the sample of a bin that a fixed sequence names
            if have[size > 0].all():
                break
            take = ~have & full[:, probe]
            table = np.where(take, table[:, probe], table)
            have |= take
        out[:, p] = table
    return out.reshape(rows, -1), size


def super_runs(mins: np.ndarray) -> np.ndarray:
    """rows x BANDS keys of KEY_BITS bits."""
    _, _, picks, salt, _ = _constants()
    key = np.zeros((len(mins), BANDS), np.uint64)
    for k in range(SPAN):
        key += mins[:, picks[:, k]] * salt[k]
        key = key << np.uint64(17) | key >> np.uint64(47)
    key += np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return cp.mix(key) >> np.uint64(64 - KEY_BITS)


def doc_number(class_hash: np.ndarray) -> np.ndarray:
    """28 bits of the class hash. Two classes may have one number; both are then looked at."""
    number = (class_hash >> np.uint64(36)).astype(np.uint32)
    return np.where(number == FILLER >> 4, np.uint32(0), number)


def doc_word(class_hash: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The document's number and its size band."""
    return doc_number(class_hash) << np.uint32(4) | size_band(size)


def _fill(gap: np.ndarray, value: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps over `top` are led up to by fillers of gap `top` without a value."""
    extra = (gap // np.uint64(top)).astype(np.int64)
    if not extra.any():
        return gap, value
    which, place = cp.expand(extra + 1)
    last = place == extra[which]
    return np.where(last, gap[which] - (extra[which] * top).astype(np.uint64), np.uint64(top)), np.where(last, value[which], FILLER)


def pack(key: np.ndarray, value: np.ndarray) -> bytes:
    """Sorted keys as gaps in byte planes, of the width that takes least room, then a 4-byte value each."""
    gap = np.diff(key, prepend=np.uint64(0))
    cost = {w: (len(gap) + int((gap // np.uint64(256**w - 1)).sum())) * (w + 4) for w in (1, 2, 3, 4, 5, 6)}
    width = min(cost, key=cost.get)
    gap, value = _fill(gap, value, 256**width - 1)
    planes = gap.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join((np.array([len(gap)], "<u4").tobytes(), bytes([width]), np.ascontiguousarray(planes.T).tobytes(), value.astype("<u4").tobytes()))


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = int(np.frombuffer(block, "<u4", 1)[0]), block[4]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(block, np.uint8, n * width, 5).reshape(width, n).T
    key, value = np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64), np.frombuffer(block, "<u4", n, 5 + n * width)
    real = value != FILLER
    return (key, value) if real.all() else (key[real], value[real])


def _emit(keys, docs, side, buckets):
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)  # copies of a text within this part
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    edges = np.searchsorted(key, [-(-(b << KEY_BITS) // buckets) for b in range(buckets + 1)])
    some = [b for b in range(buckets) if edges[b] < edges[b + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([side] * len(some), pa.int8()), pa.array([pack(key[edges[b] : edges[b + 1]], doc[edges[b] : edges[b + 1]]) for b in some], pa.binary())],
        ["bucket", "side", "block"],
    )


def _postings(buckets: int):
    def run(batches):
        held = {}  # side -> keys, docs
        for batch in batches:
            texts, sides = batch.column(0), np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            for a, b in cp.slices(texts):
                cps, off = textform.compared(*cp.decode(texts.slice(a, b - a))[:2])
                long = np.diff(off) >= SHORTEST
                cps, off = cp.keep(cps, np.concatenate((off[:1], off[1:])), np.repeat(long, np.diff(off)))
                side = sides[a:b][long]
                off = np.concatenate(([0], off[1:][long]))
                if len(off) < 2:
                    continue
                whole = cp.row_hash(cps, off)
                _, first = np.unique(np.stack((whole, side.astype(np.uint64))), axis=1, return_index=True)
                mins, size = _mins(cps, off)
                key, doc = super_runs(mins), doc_word(whole, size)
                for s in np.unique(side):
                    pick = first[side[first] == s]
                    keys, docs = held.setdefault(int(s), ([], []))
                    keys.append(key[pick].ravel())
                    docs.append(np.repeat(doc[pick], BANDS))
                    if sum(map(len, keys)) >= FLUSH:
                        yield _emit(keys, docs, int(s), buckets)
                        del held[int(s)]
        for s, (keys, docs) in held.items():
            yield _emit(keys, docs, s, buckets)

    return run


def _meet(key_a, doc_a, key_b=None, doc_b=None, chunk=1 << 20):
    """Pairs (a, b) of different documents with an equal key and near sizes, in chunks; a < b within one list."""
    alone = key_b is None
    if alone:
        lo = np.arange(1, len(key_a) + 1)
        hi = np.searchsorted(key_a, key_a, "right")
    else:
        lo, hi = np.searchsorted(key_b, key_a, "left"), np.searchsorted(key_b, key_a, "right")
    count = hi - lo
    some = np.flatnonzero(count > 0)
    total = np.cumsum(count[some])
    done = 0
    while done < len(some):
        upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + chunk, "right")))
        part = some[done:upto]
        which, place = cp.expand(count[part])
        a, b = doc_a[part[which]], (doc_a if alone else doc_b)[lo[part[which]] + place]
        gap = np.abs((a & 15).astype(np.int8) - (b & 15).astype(np.int8))
        ok = (gap <= 2) & ((a >> 4 != b >> 4) | (not alone))
        a, b = a[ok], b[ok]
        yield (np.minimum(a, b), np.maximum(a, b)) if alone else (a, b)
        done = upto


def _sorted_unique(parts):
    key, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def _tiles(batches, parts):
    held, pairs = {}, []
    for batch in batches:
        for bucket, side, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
            held.setdefault(bucket, {}).setdefault(side, []).append(block)
    for bucket in list(held):
        sides = {s: _sorted_unique([unpack(b) for b in blocks]) for s, blocks in held.pop(bucket).items()}
        if 0 in sides:
            met = _meet(*sides[0])
        elif len(sides) == 2:
            met = _meet(*sides[1], *sides[2])
        else:
            continue
        for a, b in met:
            pairs.append(a.astype(np.uint64) << np.uint64(32) | b)
            if sum(map(len, pairs)) >= FLUSH:
                yield _scatter(pairs, parts)
                pairs = []
    if pairs:
        yield _scatter(pairs, parts)


def _scatter(pairs, parts):
    """Pairs as packed blocks, one for each part: those with the same hash go to one part."""
    pair, times = np.unique(np.concatenate(pairs), return_counts=True)
    part = (cp.mix(pair) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    pair, times = pair[order], times[order].astype(np.uint32)
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    some = [p for p in range(parts) if edges[p] < edges[p + 1]]
    blocks = []
    for p in some:
        x, t = pair[edges[p] : edges[p + 1]], times[edges[p] : edges[p + 1]]
        once = t < MEETINGS
        blocks.append(pack_pairs(x[once]) + pack_pairs(x[~once]))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])


def pack_pairs(pair: np.ndarray) -> bytes:
    """Sorted pairs: gaps of the upper words, lower words as they are."""
    body = pack(pair >> np.uint64(32), (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)) if len(pair) else b""
    return np.array([len(body)], "<u4").tobytes() + body


def _counted(batches):
    """Pairs met MEETINGS times, in one tile or in several."""
    once, often = {}, {}
    for batch in batches:
        for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for held in (once, often):
                size = int(np.frombuffer(block, "<u4", 1)[0])
                if size:
                    hi, lo = unpack(block[4 : 4 + size])
                    held.setdefault(part, []).append(hi << np.uint64(32) | lo)
                block = block[4 + size :]
    for part in {*once, *often}:
        sure = np.concatenate(often.pop(part, []) or [np.empty(0, np.uint64)])
        pair, times = np.unique(np.concatenate(once.pop(part, []) or [np.empty(0, np.uint64)]), return_counts=True)
        both = np.unique(np.concatenate((sure, pair[times >= MEETINGS])))
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64))], ["pair"])


def tile_partitions(texts: DataFrame) -> int:
    """Partitions for tiles: those of the session, or more where the texts' files are so large that a tile's blocks would pass TILE_BYTES."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # tables that are not files have no known size
        size = 0
    return max(shuffle_partitions(texts.sparkSession), min(MOST_TILES, -(-size // TILE_BYTES)))


def candidates(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(pair): document words a << 32 | b that share MEETINGS super-runs. texts: (text, side), side 0, or 1 and 2 to be joined.

    The super-runs are made for similarities from THRESHOLD on; a lower
    threshold is refused, as pairs would be missed in silence.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"super-runs find pairs from a similarity of {THRESHOLD} on; use exact=True for less")
    parts = tile_partitions(texts)
    post = texts.mapInArrow(_postings(4 * parts), "bucket int, side byte, block binary").repartition(parts, "bucket")
    met = post.mapInArrow(lambda it: _tiles(it, 4 * parts), "part int, block binary").repartition(parts, "part")
    return met.mapInArrow(_counted, "pair long")


def _classes(with_text: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in cp.slices(texts):
                cps, off, valid = cp.decode(texts.slice(a, b - a))
                cps, off = textform.compared(cps, off)
                long = np.diff(off) >= SHORTEST
                whole = cp.row_hash(cps, off)
                arrays, names = [batch.column(0).slice(a, b - a), pa.array(whole.view(np.int64))], ["id", "class"]
                if with_text:
                    arrays += [pa.array(doc_number(whole).astype(np.int64)), cp.encode(cps, off, valid)]
                    names += ["doc", "text"]
                    out = pa.RecordBatch.from_arrays(arrays[1:], names[1:]).filter(pa.array(long))
                else:
                    out = pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(long))
                if with_text:
                    _, first = np.unique(out.column(0).to_numpy(), return_index=True)
                    out = out.take(pa.array(np.sort(first)))
                    out = pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(2).cast(pa.string())], names[1:])
                yield out

    return run


def members(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, class): the class of equal compared forms of each record that takes part; ids delivered again count once."""
    src = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return src.mapInArrow(_classes(False), "id string, class long").distinct()


def _jaccard(text_a, text_b, threshold):
    """Similarity of each row pair of two string columns; 0 where bit counts already show it below the threshold."""
    out = np.zeros(len(text_a))
    for i, j in cp.slices(pa.compute.binary_join_element_wise(text_a, text_b, "")):
        sets = []
        for col in (text_a, text_b):
            cps, off, _ = cp.decode(col.slice(i, j - i))
            sets.append(distinct_runs(cps, off))
        n = [np.diff(s[2]) for s in sets]
        need = np.ceil((n[0] + n[1]) * threshold / (1 + threshold) - 1e-9)
        maps = []
        for row, h, _ in sets:
            m = np.zeros((j - i, BITMAP_BITS // 8), np.uint8)
            bit = (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(m, (row, bit >> 3), np.uint8(1) << (bit & 7).astype(np.uint8))
            maps.append(m)
        apart = np.bitwise_count(maps[0] ^ maps[1]).sum(1, dtype=np.int64)
        may = (n[0] + n[1] - apart) // 2 >= need
        pick = [may[row] for row, _, _ in sets]
        x = np.sort(np.concatenate([s[1][p] for s, p in zip(sets, pick)]), kind="stable")  # two sorted arrays are merged
        same = x[1:][x[1:] == x[:-1]]
        both = np.bincount((same >> np.uint64(48)).astype(np.int64), minlength=j - i)
        out[i:j] = both / np.maximum(n[0] + n[1] - both, 1)
    return out


def _verify(threshold: float):
    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            pair = t.column("pair").to_numpy()
            last = int(np.searchsorted(pair, pair[-1])) if len(pair) else 0  # the last pair may go on in the next batch
            rest = t.slice(last)
            yield from _check(t.slice(0, last), threshold)
        if rest is not None:
            yield from _check(rest, threshold)

    return run


def _check(t, threshold):
    if not t.num_rows:
        return
    t = t.combine_chunks()
    pair, second = t.column("pair").to_numpy(), t.column("second").to_numpy(zero_copy_only=False)
    cls, text = t.column("class").to_numpy(), t.column("text").combine_chunks()
    a = np.flatnonzero(~second)
    key = pair * 1  # rows of a pair stand together, the first document's before the second's
    left, hi = np.searchsorted(key, key[a], "left"), np.searchsorted(key, key[a], "right")
    firsts = np.concatenate(([0], np.cumsum(~second)))
    lo = left + firsts[hi] - firsts[left]
    which, place = cp.expand(hi - lo)
    ia, ib = a[which], lo[which] + place
    s = _jaccard(text.take(pa.array(ia)), text.take(pa.array(ib)), threshold)
    ok = s >= threshold
    yield pa.RecordBatch.from_arrays([pa.array(cls[ia][ok]), pa.array(cls[ib][ok]), pa.array(s[ok])], ["class_a", "class_b", "similarity"])


def verified(df: DataFrame, pairs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(class_a, class_b, similarity) of the candidate pairs that reach the threshold."""
    parts = tile_partitions(df.select(text))
    docs = (
        df.select(F.lit("").alias("id"), F.col(text).alias("text")).where("text is not null")
        .mapInArrow(_classes(True), "class long, doc long, text string")
        .repartition(parts, "doc").dropDuplicates(["doc", "class"])
    )
    long = pairs.select("pair", F.explode(F.array(F.struct(F.lit(False).alias("second"), F.shiftrightunsigned("pair", 36).alias("doc")), F.struct(F.lit(True).alias("second"), F.shiftrightunsigned(F.col("pair").bitwiseAND(0xFFFFFFFF), 4).alias("doc")))).alias("x")).select("pair", "x.second", "x.doc")
    both = docs.join(long.hint("shuffle_hash"), "doc").select("pair", "second", "class", "text")
    both = both.repartition(parts, "pair").sortWithinPartitions("pair", "second", "class")
    return both.mapInArrow(_verify(threshold), "class_a long, class_b long, similarity double")


def class_links(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(class_a, class_b, similarity): the pairs of different texts that reach the threshold; copies are one class.

    Pairs next to the threshold may be missed, few of them (see the README for
    measured recall). exact=True joins by prefixes instead and misses none, at
    a cost that grows with the square of what stock phrases texts share.
    """
    if exact:
        from . import prefixes

        rows = df.where(F.col(text).isNotNull()).select(F.lit("").alias("id"), F.col(text).alias("text"))
        own = cut(rows.mapInArrow(_classes(True), "class long, doc long, text string").select("class", "text"))
        return prefixes.join(own, rows, threshold, own=True).where("id is null").select(F.col("class").alias("class_a"), F.col("other").alias("class_b"), "similarity").distinct()
    pairs = candidates(df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.lit(0).cast("byte").alias("side")), threshold)
    return verified(df, pairs, text, threshold)


def near_duplicate_pairs(df: DataFrame, key: str = "id", text: str = "text", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records that reach the threshold, copies of one text included.

    Null, blank and short texts (compared form under 60 characters) take no
    part; an id delivered again counts once; other columns of df are not read.
    """
    m = cut(members(df, key, text))
    links = class_links(df, text, threshold, exact).select("class_a", "class_b")
    copies = m.groupBy("class").count().where("count > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    return _expand(links.unionByName(copies), m, m)


def _expand(links, left, right):
    a, b = left.select(F.col("class").alias("class_a"), F.col("id").alias("x")), right.select(F.col("class").alias("class_b"), F.col("id").alias("y"))
    both = links.join(a, "class_a").join(b, "class_b")
    return both.where("x <> y and (class_a <> class_b or x < y)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(df: DataFrame, key: str = "id", text: str = "text", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(id, class_id, links): each record that takes part with its near-duplicate group and its number of links.

    A group is a connected component of the links between different texts;
    copies share their text's links, and each copy counts as one link more.
    class_id is the least id of the group.
    """
    m = cut(members(df, key, text))
    links = cut(class_links(df, text, threshold, exact).select("class_a", "class_b"))
    size = m.groupBy("class").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    # a link is an entity of its two classes
    ends = links.withColumn("entity", F.monotonically_increasing_id())
    edges = ends.select(F.col("class_a").alias("node"), "entity").unionByName(ends.select(F.col("class_b").alias("node"), "entity"))
    label = units.min_label(edges).select(F.col("node").alias("class"), F.col("label").alias("root"))
    two = links.unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    count = two.join(size.select(F.col("class").alias("class_b"), "size"), "class_b").groupBy(F.col("class_a").alias("class")).agg(F.sum("size").alias("others"))
    per = size.join(label, "class", "left").withColumn("root", F.coalesce("root", "class")).join(count, "class", "left")
    roots = per.groupBy("root").agg(F.min("least").alias("class_id"))
    per = per.join(roots, "root").select("class", "class_id", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("links"))
    return m.join(per, "class").select("id", "class_id", "links")
