"""Exact similarity join of texts by prefix filter.

Runs (see similarity.run_hashes) stand in one fixed order, rare ones first. Two
sets whose overlap must be `a` or more share a run among the first n - a + 1 of
either; that holds for any order that is the same for all texts, so the order
may come from a sketch of fixed size, and only the speed depends on it.

1. The indexed texts' runs are counted in CELLS cells; every run takes the
   place of its cell's level, then of its hash.
2. The indexed texts, one per class of equal texts and sorted by size, are put
   into blocks of at most BLOCK texts: prefix postings with positions, bitmap
   signatures and the texts themselves. The blocks are a table in the shared
   folder, read by every task block by block.
3. A batch of probing texts meets each block whose sizes are near enough. The
   places of a prefix that count depend on both sizes (length and position
   filter). Meetings are counted per pair; runs behind the prefixes can add
   only so much, which bounds the overlap from above, then bitmaps do. What is
   left is decided by exact intersection.

Nothing is sampled and no posting list is cut. A run in a third of all texts
is a posting list of at most BLOCK texts per block, and meetings are made in
chunks, so hot runs cost time but no memory.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_dir, shuffle_partitions
from . import codepoints as cp
from . import similarity as sim
from . import textform

CELLS = 1 << 22
SLOTS = 64
BLOCK = 8192
#: Places beyond the least prefix that are counted too, where the index has them: more meetings, fewer pairs to look at.
BEYOND = 12
#: Steps an octave of text lengths, from which the blocks' ranges are made up.
STEPS = 64
#: Parts of the longest prefix; a posting list holds its texts by the part in which the run stands there.
PARTS = 6
CHUNK = 1 << 19
HELD = 1 << 24
#: A meeting is 32 bits: row of the chunk, text of the block, runs that meet.
ROW_BITS, RUN_BITS = 11, 8
NAMES = ["id", "class", "other", "similarity"]
HASH = np.uint64((1 << 48) - 1)


def ordered_runs(cps, off, levels) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): each row's distinct runs, rare ones first. A key is 8 bits of level and 48 of hash."""
    keys, ends = [], [np.zeros(1, np.int64)]
    rows, at = len(off) - 1, 0
    for lo in range(0, rows, 256):
        hi = min(rows, lo + 256)
        row, h = sim.run_hashes(cps[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        h >>= np.uint64(16)
        x = levels[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | h
        x = np.sort(row.astype(np.uint64) << np.uint64(56) | x)
        if len(x):
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        size = np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=hi - lo)
        keys.append(x & np.uint64((1 << 56) - 1))
        ends.append(at + np.cumsum(size))
        at += len(x)
    return (np.concatenate(keys) if keys else np.empty(0, np.uint64)), np.concatenate(ends)


def least_overlap(a, b, threshold):
    """The overlap that sets of sizes a and b need to reach the threshold."""
    return np.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)


def prefix(n, threshold):
    """How many first runs can hold the first common one, whatever the other text's size."""
    return n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1


def taken(n, parts, threshold):
    """How many first runs stand in so many parts of the longest prefix."""
    whole = np.minimum(prefix(n, threshold), n)
    return np.where(parts == PARTS, whole, np.minimum(whole, np.ceil(n * ((1 - threshold) / PARTS * parts)).astype(np.int64)))


def bitmaps(keys, off) -> np.ndarray:
    """A hashed bitmap of the runs of each row."""
    out = np.zeros((len(off) - 1, sim.BITMAP_BITS // 8), np.uint8)
    row, bit = cp.row_of(off), (keys & np.uint64(sim.BITMAP_BITS - 1)).astype(np.int64)
    np.bitwise_or.at(out.reshape(-1), row * (sim.BITMAP_BITS // 8) + (bit >> 3), np.uint8(1) << (bit & 7).astype(np.uint8))
    return out


def _partial(batches):
    """Counts of a part by cell, one row per slot of cells."""
    total = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for a, b in cp.slices(batch.column(0)):
            cps, off, _ = cp.decode(batch.column(0).slice(a, b - a))
            _, h = sim.run_hashes(cps, off)
            cell, n = np.unique((h >> np.uint64(16) & np.uint64(CELLS - 1)).astype(np.int32), return_counts=True)
            total[cell] += n.astype(np.uint32)
    parts = total.reshape(SLOTS, -1)
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(parts[s].astype("<u4").tobytes(), 1) for s in some], pa.binary())], ["slot", "counts"])


def _level(batches):
    """Counts of all parts, as levels of an eighth of an octave."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[slot] = held.get(slot, 0) + np.frombuffer(zlib.decompress(counts), "<u4").astype(np.uint64)
    rows = [np.minimum(255, np.round(8 * np.log2(1.0 + v))).astype(np.uint8).tobytes() for v in held.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(rows, pa.binary())], ["slot", "levels"])


def levels(texts: DataFrame) -> np.ndarray:
    """How frequent the runs of each cell are in all compared texts: CELLS bytes, whatever the number of texts."""
    parts = texts.mapInArrow(_partial, "slot int, counts binary").repartition(min(SLOTS, shuffle_partitions(texts.sparkSession)), "slot")
    out = np.zeros((SLOTS, CELLS // SLOTS), np.uint8)
    for r in parts.mapInArrow(_level, "slot int, levels binary").collect():  # SLOTS rows
        out[r["slot"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


ARRAYS = ("classes", "sizes", "tokens", "lists", "starts", "docs", "bitmaps")
FIELDS = f"least int, most int, {', '.join(f'{c} binary' for c in ARRAYS)}, texts array<string>"


def _block(classes, texts, table, threshold):
    """One row of the index."""
    cps, off, _ = cp.decode(pa.array(texts, pa.large_string()))
    keys, at = ordered_runs(cps, off, table)
    n = np.diff(at)
    order = np.argsort(n, kind="stable")
    maps = bitmaps(keys, at)
    take = np.minimum(prefix(n, threshold), n)[order]
    row, place = cp.expand(take)
    key = keys[at[:-1][order][row] + place]
    part = np.zeros(len(row), np.int64)
    for k in range(1, PARTS):
        part += place >= taken(n[order], k, threshold)[row]
    by = np.lexsort((part, key))
    tokens, starts = np.unique(key[by], return_index=True)
    lists, starts, docs = _lists(np.append(starts, len(key)), row[by], part[by])
    arrays = (np.array(classes)[order].astype("<i8"), n[order].astype("<i4"), tokens.astype("<u8"), lists.astype("<i4"), starts.astype("<i4"), docs.astype("<u2"), maps[order])
    return (int(n.min()), int(n.max()), *[a.tobytes() for a in arrays], [texts[i] for i in order])


def _lists(starts, docs, part):
    """(list of each run, starts, docs): runs that stand in the same parts of the same texts have one posting list. A list has PARTS starts."""
    if not len(docs):
        return starts[:-1], starts, docs
    count = np.diff(starts)
    total = np.add.reduceat(cp.mix((docs * PARTS + part).astype(np.uint64) + np.uint64(1)), starts[:-1])
    _, first, lists = np.unique(total + count.astype(np.uint64), return_index=True, return_inverse=True)
    run, place = cp.expand(count[first])
    at = starts[first][run] + place
    sizes = np.bincount(run * PARTS + part[at], minlength=len(first) * PARTS)
    return lists, np.concatenate(([0], np.cumsum(sizes))), docs[at]


def _blocks(table, threshold):
    def run(batches):
        schema = pa.schema([("least", pa.int32()), ("most", pa.int32()), *[(c, pa.binary()) for c in ARRAYS], ("texts", pa.list_(pa.string()))])
        held, group, last = ([], []), None, None

        def flush():
            row = _block(*held, table.value, threshold)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for band, part, cls, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (band, cls) == last:
                    continue
                if held[0] and ((band, part) != group or len(held[0]) == BLOCK):
                    yield flush()
                    held = [], []
                group, last = (band, part), (band, cls)
                held[0].append(cls)
                held[1].append(text)
        if held[0]:
            yield flush()

    return run


def _bands(sizes: dict[int, int]) -> tuple[list[int], list[int], int]:
    """(band of each step, parts of its band, least step): steps of length that stand side by side, half an octave at most, make a band of up to BLOCK texts."""
    least, most = min(sizes, default=0), max(sizes, default=0)
    bands, held, began = [], [0], least
    for step in range(least, most + 1):
        n = int(1.1 * sizes.get(step, 0))
        if held[-1] and (held[-1] + n > BLOCK or step - began >= STEPS // 2):
            held.append(0)
            began = step
        held[-1] += n
        bands.append(len(held) - 1)
    return bands, [held[b] // BLOCK + 1 for b in bands], least


def write_index(texts: DataFrame, table, threshold: float) -> str:
    """Writes the blocks of compared texts (class, text) to the shared folder; returns the folder. Copies are indexed once."""
    spark = texts.sparkSession
    rows = texts.select(F.floor(STEPS * F.log2(F.length("text"))).cast("int").alias("step"), "class", "text")
    bands, spreads, least = _bands({r["step"]: r["n"] for r in rows.groupBy("step").agg(F.approx_count_distinct("class", 0.05).alias("n")).collect()})
    step = F.col("step") - least
    rows = rows.select(F.get(F.lit(bands), step).alias("band"), F.pmod("class", F.get(F.lit(spreads), step)).cast("int").alias("part"), "class", "text")
    rows = rows.repartition(shuffle_partitions(spark), "band", "part").sortWithinPartitions("band", "part", "class")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(checkpoint_dir(spark), f"prefixes-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = fs.makeQualified(path).toString()
    rows.mapInArrow(_blocks(table, threshold), FIELDS).write.parquet(folder)
    fs.deleteOnExit(path)
    return folder


class Block:
    """A row of the index."""

    def __init__(self, row: dict, table):
        take = lambda c, kind: np.frombuffer(row[c], kind)
        self.least, self.most, self.texts, self.table = row["least"], row["most"], pa.array(row["texts"], pa.large_string()), table
        self.classes, self.sizes, self.tokens, self.starts = take("classes", "<i8"), take("sizes", "<i4").astype(np.int64), take("tokens", "<u8"), take("starts", "<i4").astype(np.int64)
        self.lists, self.docs = take("lists", "<i4"), take("docs", "<u2").astype(np.uint32) << np.uint32(RUN_BITS)
        self.bitmaps = take("bitmaps", np.uint64).reshape(len(self.classes), -1)

    def runs(self, docs):
        """The runs of some of its texts."""
        return ordered_runs(*cp.decode(self.texts.take(pa.array(docs)))[:2], self.table)


class Index:
    """The index as tasks read it: block by block, from the shared folder."""

    def __init__(self, folder: str, table):
        from pyarrow import fs

        if folder.startswith("file:"):
            folder = "/" + folder[5:].lstrip("/")
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.table = table
        self.files = sorted(f.path for f in self.fs.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))

    def blocks(self, least: int, most: int):
        """The blocks with texts of the given sizes."""
        for path in self.files:
            with self.fs.open_input_file(path) as f:
                table = pyarrow.parquet.ParquetFile(f)
                for g in range(table.num_row_groups):
                    sizes = table.read_row_group(g, ["least", "most"]).to_pylist()
                    if not any(s["least"] <= most and s["most"] >= least for s in sizes):
                        continue
                    for batch in pyarrow.parquet.ParquetFile(f).iter_batches(1, [g]):
                        row = batch.to_pylist()[0]
                        if row["least"] <= most and row["most"] >= least:
                            yield Block(row, self.table)


class Probe:
    """Texts that probe: their runs in order, and the postings of their prefixes by row."""

    def __init__(self, keys, at, threshold: float):
        self.keys, self.at, self.n, self.threshold = keys, at, np.diff(at), threshold
        size = np.minimum(prefix(self.n, threshold), self.n)
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.place = (np.arange(len(self.row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        key = np.repeat(at[:-1], size)
        key += self.place
        key = keys[key]
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.tokens, self.token = key[new], np.empty(len(key), np.int32)
        del key
        self.token[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        self.first = np.concatenate(([0], np.cumsum(size)))  # postings of each row
        maps = [bitmaps(keys[at[lo] : at[min(lo + 1024, len(size))]], at[lo : lo + 1025] - at[lo]) for lo in range(0, len(size), 1024)]
        self.bitmaps = np.concatenate(maps or [np.zeros((0, sim.BITMAP_BITS // 8), np.uint8)]).view(np.uint64)


def meet(probe: Probe, block: Block):
    """(row, doc, similarity): all pairs of a probing row and a block's text that reach the threshold."""
    n, threshold, docs = probe.n, probe.threshold, len(block.sizes)
    near = (n > 0) & (n >= np.ceil(block.least * threshold - 1e-9)) & (n * threshold <= block.most + 1e-9)
    if not near.any():
        return
    # places that can hold the first common run with a text of this block's sizes, and some beyond
    low = np.maximum(max(1, block.least), np.ceil(n * threshold - 1e-9).astype(np.int64))
    take = np.minimum(n - least_overlap(n, low, threshold) + 1 + BEYOND, np.minimum(prefix(n, threshold), n))
    pos = np.minimum(np.searchsorted(block.tokens, probe.tokens), len(block.tokens) - 1)
    found = np.where(block.tokens[pos] == probe.tokens, block.lists[pos], -1)
    span = np.flatnonzero(near)[[0, -1]]
    span = slice(probe.first[span[0]], probe.first[span[1] + 1])  # few others are in between where rows come by size
    probing, found = probe.row[span], found[probe.token[span]]
    some = np.flatnonzero((found >= 0) & (probe.place[span] < np.where(near, take, 0).astype(np.int32)[probing]))
    if not len(some):
        return
    # runs of a row with one posting list are looked up once, and count as many times
    both = np.sort(probing[some].astype(np.int64) << 32 | found[some])
    edge = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1], [True])))
    weight, both = np.diff(edge), both[edge[:-1]]
    row, which = both >> 32, (both & 0xFFFFFFFF) * PARTS
    # parts of the block's prefixes that can hold the first common run, and some places beyond
    most = np.maximum(low, np.minimum(block.most, np.floor(n / threshold + 1e-9).astype(np.int64)))
    share = 1 - threshold / (1 + threshold) * (1 + n / most) + (2 + BEYOND) / low
    parts = np.clip(np.ceil(share * PARTS / max(1 - threshold, 1e-9)), 1, PARTS).astype(np.int64)
    start = block.starts[which]
    count = block.starts[which + parts[row]] - start
    some = np.flatnonzero(count)
    if not len(some):
        return
    row, weight, start, count = row[some], weight[some], start[some], count[some]
    total = np.concatenate(([0], np.cumsum(count)))
    first = np.concatenate((np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))), [len(row)]))  # lists of each row
    rows = row[first[:-1]]
    fewest = np.maximum(1, np.minimum(_fewest(n, low, take, parts, threshold), _fewest(n, most, take, parts, threshold)))
    done = 0
    while done < len(rows):
        stop = int(np.searchsorted(total[first], total[first[done]] + CHUNK, "right")) - 1
        stop = min(max(stop, done + 1), done + (1 << ROW_BITS), len(rows))
        a, b = first[done], first[stop]
        chunk, at = rows[done:stop], np.repeat(np.arange(stop - done), np.diff(first[done : stop + 1]))
        yield from _pairs(probe, block, chunk, take, parts, *_met(block, at, start[a:b], count[a:b], weight[a:b], fewest[chunk]))
        done = stop


def _met(block, row, start, count, weight, fewest):
    """(row, doc, meetings) of the pairs with the meetings that their row needs."""
    most = (1 << RUN_BITS) - 1
    if weight.max() > most:
        again, place = cp.expand(-(-weight // most))
        row, start, count, weight = row[again], start[again], count[again], np.minimum(weight[again] - place * most, most)
    base = (row << (32 - ROW_BITS) | weight).astype(np.uint32)
    part = np.cumsum(count)
    cells, mets, done = [], [], 0
    while done < len(row):  # a row of very many meetings is counted in several goes
        stop = max(done + 1, int(np.searchsorted(part, (part[done - 1] if done else 0) + 8 * CHUNK, "right")))
        c = count[done:stop]
        place = np.repeat((start[done:stop] - (np.cumsum(c) - c)).astype(np.int32), c)
        place += np.arange(len(place), dtype=np.int32)
        x = block.docs[place]
        x += np.repeat(base[done:stop], c)
        x.sort()
        cell = x >> np.uint32(RUN_BITS)
        new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        x &= np.uint32(most)
        upto = np.cumsum(x, dtype=np.int32)[np.append(new[1:], len(x)) - 1]
        mets.append(np.diff(upto, prepend=np.int32(0)))
        cells.append(cell[new])
        done = stop
    cell, met = cells[0], mets[0]
    if len(cells) > 1:
        cell, back = np.unique(np.concatenate(cells), return_inverse=True)
        met = np.bincount(back, np.concatenate(mets)).astype(np.int64)
    row = (cell >> np.uint32(32 - ROW_BITS - RUN_BITS)).astype(np.int32)
    ok = np.flatnonzero(met >= fewest.astype(np.int32)[row])
    return row[ok], (cell[ok] & np.uint32((1 << 32 - ROW_BITS - RUN_BITS) - 1)).astype(np.int64), met[ok].astype(np.int64)


def _behind(nx, ny, take, parts, threshold):
    """What stands behind the prefix that ends first can add to the overlap, and no more."""
    return np.maximum(nx - take, ny - taken(ny, parts, threshold))


def _fewest(nx, ny, take, parts, threshold):
    """The meetings that a pair needs. Between two sizes ny it is never below the lesser of theirs less 2."""
    return least_overlap(nx, ny, threshold) - _behind(nx, ny, take, parts, threshold) - 2


def _pairs(probe, block, rows, take, parts, x, y, c):
    n, threshold = probe.n, probe.threshold
    x = rows[x]
    nx, ny = n[x], block.sizes[y]
    need = least_overlap(nx, ny, threshold)
    ok = (np.minimum(nx, ny) >= need) & (c + _behind(nx, ny, take[x], parts[x], threshold) >= need)
    x, y, need = x[ok], y[ok], need[ok]
    if not len(x):
        return
    keep = np.zeros(len(x), bool)
    for lo in range(0, len(x), 8192):
        p = slice(lo, lo + 8192)
        apart = np.bitwise_count(probe.bitmaps[x[p]] ^ block.bitmaps[y[p]]).sum(1, dtype=np.int64)
        keep[p] = (n[x[p]] + block.sizes[y[p]] - apart) // 2 >= need[p]
    x, y, need = x[keep], y[keep], need[keep]
    if not len(x):
        return
    texts, rx = np.unique(x, return_inverse=True)
    px, ox = _some(probe.keys, probe.at, texts)
    texts, ry = np.unique(y, return_inverse=True)
    py, oy = block.runs(texts)
    for lo in range(0, len(x), 2048):
        p = slice(lo, lo + 2048)
        both = common((px, ox), rx[p], (py, oy), ry[p])
        ok = both >= need[p]
        yield x[p][ok], y[p][ok], both[ok] / (n[x[p]] + block.sizes[y[p]] - both)[ok]


def _some(keys, at, rows):
    lens = (at[1:] - at[:-1])[rows]
    row, place = cp.expand(lens)
    return keys[at[rows][row] + place], np.concatenate(([0], np.cumsum(lens)))


def common(left, a, right, b) -> np.ndarray:
    """The exact size of the intersection of rows a of one and rows b of another list of sorted sets."""
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), 128):
        pair = np.arange(len(a[lo : lo + 128]))
        merged = []
        for (keys, at), rows in ((left, a[lo : lo + 128]), (right, b[lo : lo + 128])):
            k, o = _some(keys, at, rows)
            merged.append(np.repeat(pair, np.diff(o)).astype(np.uint64) << np.uint64(56) | k)
        x = np.sort(np.concatenate(merged), kind="stable")
        same = x[1:][x[1:] == x[:-1]]
        out[lo : lo + 128] = np.bincount((same >> np.uint64(56)).astype(np.int64), minlength=len(pair))
    return out


def _probe(folder, table, threshold, own):
    def found(index, ids, texts):
        """Record batches of the members and the pairs of some probing texts."""
        forms = [textform.compared(*cp.decode(texts.slice(a, b - a))[:2]) for a, b in cp.slices(texts)]
        whole = np.concatenate([cp.row_hash(c, o).view(np.int64) for c, o in forms])
        off = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(o) for _, o in forms]))))
        cps = np.concatenate([c for c, _ in forms])
        del forms
        long = np.diff(off) >= sim.SHORTEST
        yield pa.RecordBatch.from_arrays([ids, pa.array(whole), pa.nulls(len(whole), pa.int64()), pa.nulls(len(whole), pa.float64())], NAMES).filter(pa.array(long))
        _, one = np.unique(whole, return_index=True)
        one = one[long[one]]  # copies probe once
        one = one[np.argsort(np.diff(off)[one], kind="stable")]  # rows near a block's sizes stand together
        keys, ends = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
        for lo in range(0, len(one), 1024):
            part, at = ordered_runs(*_some(cps, off, one[lo : lo + 1024]), table.value)
            keys.append(part)
            ends.append(ends[-1][-1] + at[1:])
        del cps
        probe, whole = Probe(np.concatenate(keys), np.concatenate(ends), threshold), whole[one]
        del keys
        n = probe.n
        if not len(n):
            return
        for block in index.blocks(math.ceil(int(n.min()) * threshold - 1e-9), int(n.max() / threshold + 1e-9)):
            for x, y, s in meet(probe, block):
                a, b = whole[x], block.classes[y]
                ok = a < b if own else slice(None)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a[ok]), ids.type), pa.array(a[ok]), pa.array(b[ok]), pa.array(s[ok])], NAMES)

    def run(batches):
        index, held, size = Index(folder, table.value), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD:  # the more texts probe at once, the less often the index is read
                t = pa.Table.from_batches(held).combine_chunks()
                yield from found(index, t.column(0).combine_chunks(), t.column(1))
                held, size = [], 0
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from found(index, t.column(0).combine_chunks(), t.column(1))

    return run


def join(texts: DataFrame, probing: DataFrame, threshold: float, own: bool = False) -> DataFrame:
    """(id, class, other, similarity): a row (id, class) for each probing record that takes part and a row (class, other, similarity) for each pair that reaches the threshold.

    texts: (class, text) in compared form, to be indexed; probing: (id, text)
    as delivered. own: both are the same records, and each pair comes once.
    A pair may come from several batches if its texts are repeated.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark: SparkSession = texts.sparkSession
    table = spark.sparkContext.broadcast(levels(texts.select("text")))  # CELLS bytes
    folder = write_index(texts, table, threshold)
    return probing.select("id", "text").where("id is not null and text is not null").mapInArrow(_probe(folder, table, threshold, own), "id string, class long, other long, similarity double")
