"""Vectorised text work over Arrow batches.

Texts of a batch are taken as one byte array with offsets. Words, spans and
their 64-bit hashes come from whole-array numpy steps, so the cost per byte is
the same for one long text and for many short ones. A null text counts as an
empty one. No text is cut: a text longer than the piece size is a piece alone.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: just under a power of two, to which the tables of powers are rounded up
PIECE_BYTES = (1 << 20) - 64
#: rows of text in an Arrow batch; the default of 10,000 is made for narrow rows
BATCH_ROWS = "1000"
PIECE_ROWS = 4096

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ALL = (1 << 64) - 1
ODD = np.uint64(0x2545F4914F6CDD1D)
ODD_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))

#: bytes of a word under ``[^\x20\x09-\x0D]+``
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, every other byte itself
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def short_batches(df):
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows, unless the user
    has set a number: a batch of long texts is held by the JVM and by Python."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(key) == "10000":
        conf.set(key, BATCH_ROWS)
    return df


def neutral(docs):
    """``docs`` with every column but doc_id and text under a neutral name, so
    that none clashes with a column an operator adds."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_other{k}" for k, c in enumerate(docs.columns)])


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and
    several of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0 or pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def pieces(batches, column="text", limit=PIECE_BYTES, rows=PIECE_ROWS):
    """Slices of the batches with at most ``limit`` bytes of text and ``rows`` rows, but one row at least."""
    for b in batches:
        n, at = b.num_rows, 0
        _, offs = flat(b.column(column))
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            to = min(n, to, at + rows)
            yield b.slice(at, to - at)
            at = to
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64, for i below n."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((ODD, ODD_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * ODD**i, from which any span's hash follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span; equal bytes give equal hashes anywhere."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64) * M1)


def words(data: np.ndarray, offs: np.ndarray, table=WORD_BYTES):
    """Starts, ends and text numbers of the words; a word never crosses texts."""
    inside = table[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    full = offs[:-1] < offs[1:]
    before[offs[:-1][full]] = False
    after[offs[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data, offs, table=WORD_BYTES, lower=True):
    """Hashes of the words and, per text, the offsets into them."""
    starts, ends, doc = words(data, offs, table)
    sums = prefix_sums(LOWER[data] if lower else data)
    return span_hashes(sums, starts, ends), np.searchsorted(doc, np.arange(len(offs)))


def shingles(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, with offsets per
    text. A text of fewer words, but not none, is one run of all its words."""
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(out_at[-1], np.uint64)
    long = n >= width
    if len(h) >= width:
        acc = np.full(len(h) - width + 1, width * int(M3) & ALL, np.uint64)
        for k in range(width):
            acc = acc * ODD + h[k:len(h) - width + 1 + k]
        last = np.repeat(at[1:] - width, n)[:len(acc)]
        out[np.repeat(long, count)] = mix(acc[np.arange(len(acc)) <= last])
    for i in np.flatnonzero(~long & (n > 0)):
        acc = np.uint64(int(n[i]) * int(M3) & ALL)
        with np.errstate(over="ignore"):
            for x in h[at[i]:at[i + 1]]:
                acc = acc * ODD + x
        out[out_at[i]] = mix(np.array([acc], np.uint64))[0]
    return out, out_at
