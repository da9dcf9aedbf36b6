"""Words of Arrow text columns as 64-bit hashes, by whole arrays and without Python strings."""

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240131))
_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20

_bytes = np.arange(256)
#: Bytes of words that end at white space, and of words made of digits, letters and non-ASCII.
NOT_SPACE = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))
ALPHANUMERIC = (
    (_bytes >= 128) | ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 65) & (_bytes <= 90))
    | ((_bytes >= 97) & (_bytes <= 122))
)
_LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes)


def _powers(base, n):
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_UP = _powers(np.uint64(_BASE), _PIECE + 1)
_DOWN = _powers(np.uint64(pow(_BASE, -1, 2**64)), _PIECE + 1)


def mixed(x):
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(hashes, order):
    """Hash of each run of ``order`` consecutive values (none if there are fewer)."""
    n = len(hashes) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n] + np.uint64(k + 1))
    return out


def text_bytes(column):
    """(bytes, offsets) of an Arrow string column; NULL counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _piece_hashes(data, starts, ends):
    """Hashes of the words [starts, ends) of at most _PIECE bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[_LOWER[data]] * _UP[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def _long_hash(data):
    """Hash of one word of any length, piece by piece, equal to ``_piece_hashes``."""
    total, shift = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for at in range(0, len(data), _PIECE):
        part = data[at:at + _PIECE]
        total += shift * np.sum(_VALUES[_LOWER[part]] * _UP[:len(part)], dtype=np.uint64)
        shift = shift * _UP[_PIECE]
    return mixed(total + np.uint64(len(data)))[0]


def word_hashes(column, kind=NOT_SPACE, prefix=0):
    """(hashes, bounds): words of all rows in order, row i has those of ``bounds[i]:bounds[i + 1]``.

    Letters A-Z count as a-z. Equal words have equal hashes; different ones differ but for the chance of
    64 random bits. With ``prefix``, a third array has the hashes of the words' first so many bytes. Memory
    beside the result is bounded by a piece of 1 MiB, however long a text is.
    """
    data, offsets = text_bytes(column)
    inside = kind[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first] = inside[first]
    stop[last] = inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    out = np.empty(len(starts), np.uint64)
    short = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + _PIECE, "right"))
        base = starts[at]
        if to <= at:
            out[at] = _long_hash(data[base:ends[at]])
            if prefix:
                short[at] = _long_hash(data[base:base + prefix])
            at += 1
            continue
        piece, s, e = data[base:ends[to - 1]], starts[at:to] - base, ends[at:to] - base
        out[at:to] = _piece_hashes(piece, s, e)
        if prefix:
            short[at:to] = _piece_hashes(piece, s, np.minimum(e, s + prefix))
        at = to
    bounds = np.searchsorted(starts, offsets)
    return (out, bounds, short) if prefix else (out, bounds)


def small_batches(batches, limit=4 << 20):
    """The Arrow batches cut so that each holds about ``limit`` bytes, or one row."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            size = batch.num_rows - at
            while size > 1 and batch.slice(at, size).nbytes > limit:
                size //= 2
            yield batch.slice(at, size)
            at += size
