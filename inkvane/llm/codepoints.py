"""Arrow string columns as flat numpy code-point arrays, and back.

A batch of texts is decoded once as a whole: no call is made per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute


def decode(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, row offsets into them, validity) of an Arrow string column.

    A null row has length 0 and validity False; an empty text has length 0 and
    validity True. Bytes that aren't UTF-8 become U+FFFD.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    valid = np.ones(n, bool) if not col.null_count else col.is_valid().to_numpy(zero_copy_only=False)
    _, off_buf, data_buf = col.buffers()
    if n == 0 or off_buf is None:
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64), valid
    off = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + n + 1]
    if not valid.all():  # what lies under a null row need not be empty
        return decode_valid(col.fill_null(""), valid)
    return _decode(data_buf, off, valid)


def decode_valid(col, valid):
    _, off_buf, data_buf = col.buffers()
    off = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + len(col) + 1]
    return _decode(data_buf, off, valid)


def _decode(data_buf, off, valid):
    raw = np.frombuffer(data_buf, np.uint8)[off[0] : off[-1]] if data_buf is not None else np.empty(0, np.uint8)
    off = off - off[0]
    try:
        text = raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
        lens = np.array([len(r) for r in rows], np.int64)
        cps = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        return cps, np.concatenate(([0], np.cumsum(lens))), valid
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, off, valid
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
    return cps, starts[off], valid


def encode(cps: np.ndarray, off: np.ndarray, valid: np.ndarray) -> pa.Array:
    """An Arrow large_string column from code points and row offsets; invalid rows are null."""
    data = cps.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) == len(cps):
        at = off
    else:
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        at = np.concatenate(([0], np.cumsum(width)))[off]
    nulls = None
    if not valid.all():
        nulls = pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(
        pa.large_string(), len(valid), [nulls, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)]
    )


def row_of(off: np.ndarray) -> np.ndarray:
    """The row number of every code point."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def keep(cps: np.ndarray, off: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points under the mask, with the row offsets that belong to them."""
    at = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return cps[mask], at[off]


def expand(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: the run each output place belongs to, and its place in that run."""
    total = int(lens.sum())
    run = np.repeat(np.arange(len(lens)), lens)
    first = np.cumsum(lens) - lens
    return run, np.arange(total) - first[run]


def slices(col, most: int = 1 << 20):
    """Row ranges (start, stop) of a string column with about `most` bytes each, at least one and at most 65,536 rows."""
    n = len(col)
    if not n:
        return
    sizes = np.asarray(pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    part = np.cumsum(sizes + most // 65536) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [n])))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def row_hash(cps: np.ndarray, off: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each row's code points and their order."""
    lens = np.diff(off)
    place = np.arange(len(cps), dtype=np.uint64) - np.repeat(off[:-1], lens).astype(np.uint64)
    h = mix((place << np.uint64(21) | cps) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
    return mix(total[off[1:]] - total[off[:-1]] + lens.astype(np.uint64))
