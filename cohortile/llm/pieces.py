"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The pieces and their scores come from a public BPE model file; its path is a
parameter. A text is cut into chunks (a run of spaces and what follows up to the
next space or line end), which no piece of a BPE model with split white space
crosses; that is checked when the model is loaded. Inside a chunk the merges stand on an
agenda ordered by score, then position. Each candidate merge that comes up is
skipped for good with probability ``dropout``. Every occurrence of a chunk draws
for itself: its state is a keyed hash of (seed, document's key, the chunk's place in
the text), and from it come the numbers of merges between one skip and the next
(geometric, so the same as one draw a merge). Equal inputs always give equal output.
All occurrences that have a skip
are merged together, in lock-step over arrays: each round finds the best pair of every
row and merges or skips it. What a chunk becomes without skips is kept; the cache never
changes the ids. ``variants`` is an option that bounds
the draws instead: key and place modulo it, so a word is cut in at most that many ways.

dropout 0 is the plain encoding of the model. Characters outside the vocabulary,
and the space mark itself, become UTF-8 byte pieces, so decoding returns the
text exactly.

Defined cases: null gives null ids and decodes to null; empty text gives no ids.
"""

from __future__ import annotations

import bisect
import heapq
import os
import re
import struct
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import neutral
from .text import pieces as text_pieces
from .text import short_batches

MARK = "▁"
#: longest chunk whose agenda is a plain list
SCAN = 48
#: merges left where no skip can come
NEVER = 1 << 60
#: rows are merged together up to these lengths, and so many of them at once
WIDTHS, ROWS = (4, 8, 12, 16, 24, 32, SCAN), 1 << 15
#: longest table of gaps; a gap that runs off it is drawn on
GAPS = 1 << 12
ALL, STEP, TURN, M1, M2 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def mixed(x):
    """64-bit mixing of a Python int or of a uint64 array."""
    if isinstance(x, int):
        x = ((x ^ x >> 30) * M1) & ALL
        x = ((x ^ x >> 27) * M2) & ALL
        return x ^ x >> 31
    x = (x ^ x >> np.uint64(30)) * np.uint64(M1)
    x = (x ^ x >> np.uint64(27)) * np.uint64(M2)
    return x ^ x >> np.uint64(31)


class Ragged:
    """Rows of numbers one after the other, that grow at the end."""

    def __init__(self):
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def extend(self, flat, sizes):
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def sizes(self, rows):
        return self.at[rows + 1] - self.at[rows]


class Codec:
    """Encoder and decoder over one model file."""

    def __init__(self, model=MODEL, dropout=0.1, seed=1, variants=None, cache=1 << 19):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.drop, self.seed, self.variants, self.limit = int(dropout * (1 << 32)), seed, variants, cache
        # a gap is at least k if a 64-bit draw is under 2^64 (1 - dropout)^k; ascending
        ends, t = [], 1 << 128
        while self.drop and len(ends) < GAPS and (t := t * ((1 << 32) - self.drop) >> 32) >> 64:
            ends.append(t >> 64)
        self.ends, self.endless = ends[::-1], len(ends) == GAPS
        self.table = np.array(self.ends, np.uint64)
        text, self.byte, self.bytes = {}, {}, [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)], self.bytes[i] = i, bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} crosses a space; this codec needs a model with split white space")
                text[p], self.bytes[i] = i, p.replace(MARK, " ").encode()
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces, so it cannot be lossless")
        # a symbol is its piece's rank by score, so the best merge is the least number
        order = sorted(text, key=lambda p: (-sp.get_score(text[p]), text[p]))
        rank = {p: r for r, p in enumerate(order)}
        self.ids = [text[p] for p in order]
        self.none = len(order)
        self.chars = {p: r for p, r in rank.items() if len(p) == 1}
        for p in order:
            for c in p:
                if c not in self.chars:  # a character that only stands inside longer pieces
                    self.chars[c] = len(self.ids)
                    self.ids.append(None)
        self.spelled = {r: c for c, r in self.chars.items() if self.ids[r] is None}
        self.merge = {}
        for p, r in rank.items():
            for k in range(1, len(p)):
                left, right = (self.chars.get(x) if len(x) == 1 else rank.get(x) for x in (p[:k], p[k:]))
                if left is not None and right is not None:
                    self.merge[left << 24 | right] = r
        # no piece holds a line end in most models; then it parts chunks as well
        line = "" if any("\n" in p for p in order) else "\\n"
        self.width = np.array([len(b) for b in self.bytes], np.int64)
        self.where, self.blob = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(self.bytes), np.uint8)
        self.split = re.compile(f" *[^ {MARK}{line}]+| +|[{MARK}{line}]").findall
        # merges as an open-addressed table, at most a third full, for whole arrays of pairs
        keys, ranks = np.fromiter(self.merge, np.int64, len(self.merge)), np.fromiter(self.merge.values(), np.int32, len(self.merge))
        self.bits = max(8, (3 * len(keys)).bit_length())
        self.slots, self.found = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        spot, rest = self._spot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.slots[spot[rest]] < 0]
            _, first = np.unique(spot[free], return_index=True)
            won = free[first]
            self.slots[spot[won]], self.found[spot[won]] = keys[won], ranks[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            spot[rest] = (spot[rest] + 1) & ((1 << self.bits) - 1)
        self.id_of = np.array([-1 if i is None else i for i in self.ids], np.int32)
        self._forget()

    def _forget(self):
        """Empty cache: of every chunk met, its symbols, its plain ids, and how many merges they took."""
        self.code: dict[str, int] = {}
        self.symbols, self.plain = Ragged(), Ragged()
        self.merges = np.zeros(0, np.int64)

    def _spot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(STEP)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of every pair of symbols, ``none`` where there is none."""
        key = left.astype(np.int64) << 24 | right
        spot = self._spot(key)
        got = self.slots[spot]
        out = np.where(got == key, self.found[spot], np.int32(self.none))
        more = np.flatnonzero((got != key) & (got >= 0))
        while len(more):
            spot[more] = (spot[more] + 1) & ((1 << self.bits) - 1)
            got = self.slots[spot[more]]
            hit = got == key[more]
            out[more[hit]] = self.found[spot[more[hit]]]
            more = more[~hit & (got >= 0)]
        return out

    def gap(self, state: int, j: int) -> int:
        """Merges between skip ``j`` of an occurrence and the one before it."""
        if not self.drop:
            return NEVER
        return self._on(mixed((state + (j + 1) * TURN) & ALL))

    def _on(self, u: int) -> int:
        size = len(self.ends)
        k = total = size - bisect.bisect_right(self.ends, u)
        while self.endless and k == size:
            u = mixed(u ^ STEP)
            k = size - bisect.bisect_right(self.ends, u)
            total += k
        return total

    def gaps(self, state: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``gap`` for arrays of occurrences and skips."""
        u = mixed(state + (j.astype(np.uint64) + np.uint64(1)) * np.uint64(TURN))
        out = len(self.table) - np.searchsorted(self.table, u, "right")
        if self.endless:
            for i in np.flatnonzero(out == len(self.table)).tolist():
                out[i] = self._on(int(u[i]))
        return out

    def draws(self, chunks: list[str], key: int) -> tuple[np.ndarray, np.ndarray]:
        """State and first gap of each chunk of a text."""
        at = np.arange(len(chunks), dtype=np.uint64)
        if self.variants:
            at = (at + np.uint64(key % self.variants)) % np.uint64(self.variants)
            of = np.array([xxhash.xxh64_intdigest(c, self.seed & ALL) for c in chunks], np.uint64)
        else:
            of = np.uint64(xxhash.xxh64_intdigest(struct.pack("<Q", key & ALL), self.seed & ALL))
        state = mixed(of + (at + np.uint64(1)) * np.uint64(STEP))
        if not self.drop:
            return state, np.full(len(chunks), NEVER)
        return state, self.gaps(state, np.zeros(len(state), np.uint64))

    def chunk(self, chunk: str, state: int) -> tuple[bytes, list[int], int]:
        """Ids (int32) of one occurrence of a chunk, the gaps before its skips and the merges after the last one.

        A word's agenda is a list scanned for its best entry; that of a long
        chunk is a heap. Order and result are the same.
        """
        if chunk == MARK:
            return np.array([self.byte[b] for b in MARK.encode()], np.int32).tobytes(), [], 0
        chunk = chunk.replace(" ", MARK)
        get, unknown = self.chars.get, self.none + (1 << 22)
        symbols = [get(c, unknown) for c in chunk]
        starts = list(range(len(symbols)))
        path, rest = (self._scan if len(symbols) <= SCAN else self._heap)(symbols, starts, state)
        out, ids = [], self.ids
        for s, at in zip(symbols, starts):
            i = ids[s] if s < unknown else None
            if i is None:
                out.extend([self.byte[b] for b in chunk[at].encode()])
            else:
                out.append(i)
        return struct.pack(f"{len(out)}i", *out), path, rest

    def _scan(self, symbols, starts, state):
        merge, none, path = self.merge.get, self.none, []
        gap = left = self.gap(state, 0)
        pairs = [merge(x << 24 | y, none) for x, y in zip(symbols, symbols[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            if not left:
                pairs[i] = none
                path.append(gap)
                gap = left = self.gap(state, len(path))
                continue
            left -= 1
            symbols[i] = best
            del symbols[i + 1], starts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = merge(symbols[i - 1] << 24 | best, none)
            if i < len(pairs):
                pairs[i] = merge(best << 24 | symbols[i + 1], none)
        return path, gap - left

    def _heap(self, symbols, starts, state):
        merge, n, path = self.merge.get, len(symbols), []
        gap = left = self.gap(state, 0)
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(a):
            if after[a] < n:
                r = merge(symbols[a] << 24 | symbols[after[a]])
                if r is not None:
                    heapq.heappush(agenda, (r, a, symbols[a], symbols[after[a]]))

        for a in range(n):
            offer(a)
        while agenda:
            r, a, first, second = heapq.heappop(agenda)
            b = after[a]
            if symbols[a] != first or b >= n or symbols[b] != second:
                continue
            if not left:
                path.append(gap)
                gap = left = self.gap(state, len(path))
                continue
            left -= 1
            symbols[a], symbols[b] = r, None
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        starts[:] = [a for a in range(n) if symbols[a] is not None]
        symbols[:] = [s for s in symbols if s is not None]
        return path, gap - left

    def _lockstep(self, flat, starts, lengths, state=None, gap=None):
        """Merges many rows of symbols (``flat`` from ``starts``) at once, one
        merge or skip per row and round: their ids row by row, the number of ids
        and of merges per row. A row that ends with a symbol without id has a
        count of -1. Without ``state`` no merge is skipped."""
        counts, merges, parts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), []
        lower = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > lower) & (lengths <= width))
            lower = width
            for lo in range(0, len(rows), ROWS):
                r = rows[lo:lo + ROWS]
                ids, counts[r], merges[r] = self._round(flat, starts[r], lengths[r], width, None if state is None else state[r], None if gap is None else gap[r])
                parts.append((r, ids))
        # rows were done by width; back to their order
        out_at = np.concatenate([[0], np.cumsum(np.maximum(counts, 0))])
        out = np.empty(out_at[-1], np.int32)
        for r, ids in parts:
            n = np.maximum(counts[r], 0)
            out[np.repeat(out_at[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return out, counts, merges

    def _round(self, flat, starts, n, width, state, gap):
        none, m = np.int32(self.none), len(starts)
        cols = np.arange(width)
        live = cols[None] < n[:, None]
        sym = np.where(live, flat[np.minimum(starts[:, None] + cols, len(flat) - 1)], -1).ravel()
        pair = np.full(m * width, none, np.int32)
        has = np.flatnonzero((cols[None] < n[:, None] - 1).ravel())
        pair[has] = self.ranks(sym[has], sym[has + 1])
        after = np.tile(cols + 1, m)
        before = np.tile(cols - 1, m)
        left = np.full(m, NEVER) if gap is None else gap.astype(np.int64)
        skips, merged = np.zeros(m, np.int64), np.zeros(m, np.int64)
        table = pair.reshape(m, width)
        act = np.arange(m)
        while len(act):
            part = table[act]
            at = part.argmin(1)
            best = part[np.arange(len(act)), at]
            go = best < none
            act, at, best = act[go], at[go], best[go]
            skip = left[act] == 0
            if skip.any():
                a = act[skip]
                pair[a * width + at[skip]] = none
                skips[a] += 1
                left[a] = self.gaps(state[a], skips[a])
            a, p, b = act[~skip], at[~skip], best[~skip]
            left[a] -= 1
            merged[a] += 1
            base = a * width
            here = base + p
            q = base + after[here]
            r = after[q]
            sym[here], sym[q], pair[q], after[here] = b, -1, none, r
            ok = r < n[a]
            nxt = base[ok] + r[ok]
            before[nxt] = p[ok]
            new = np.full(len(a), none, np.int32)
            new[ok] = self.ranks(b[ok], sym[nxt])
            pair[here] = new
            l = before[here]
            ok = l >= 0
            prev = base[ok] + l[ok]
            pair[prev] = self.ranks(sym[prev], b[ok])
        keep = sym >= 0
        ids = self.id_of[sym[keep]]
        counts = keep.reshape(m, width).sum(1)
        if (ids < 0).any():
            row = np.repeat(np.arange(m), counts)
            odd = np.zeros(m, bool)
            odd[row[ids < 0]] = True
            ids, counts = ids[~odd[row]], np.where(odd, -1, counts)
        return ids, counts, merged

    def _learn(self, chunks: list[str]) -> None:
        """Put chunks not met before into the cache. A long chunk, or one with a
        character that the model spells in bytes, is worked out alone each time:
        it has no symbols there."""
        lists, get, unknown = [], self.chars.get, self.none + (1 << 22)
        for c in chunks:
            x = [get(y, unknown) for y in c.replace(" ", MARK)] if len(c) <= SCAN and c != MARK else []
            lists.append([] if unknown in x else x)
        n = np.array([len(x) for x in lists], np.int64)
        flat = np.array([y for x in lists for y in x], np.int32)
        ids, counts, merges = self._lockstep(flat, np.cumsum(n) - n, n)
        n = np.where(counts < 0, 0, n)
        good = np.repeat(counts >= 0, [len(x) for x in lists])
        base = len(self.code)
        for i, c in enumerate(chunks):
            self.code[c] = base + i
        self.symbols.extend(flat[good], n)
        self.plain.extend(ids, np.maximum(counts, 0))
        self.merges = np.concatenate([self.merges, merges])

    def encode_all(self, texts: list, keys) -> list:
        """Ids of every text of a piece (None for None); all occurrences of all
        its chunks are drawn, looked up and merged together."""
        # a space is put before the text, as the model was trained; decoding takes it off
        split = [self.split(" " + t) if t else [] for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        chunks = [c for x in split for c in x]
        if not chunks:
            return [None if t is None else np.zeros(0, np.int32) for t in texts]
        if len(self.code) > self.limit:
            self._forget()
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.code]
        if fresh:
            self._learn(fresh)
        code = np.fromiter(map(self.code.__getitem__, chunks), np.int64, len(chunks))
        drawn = [self.draws(x, k) for x, k in zip(split, keys, strict=True) if x]
        state, gap = (np.concatenate(x) for x in zip(*drawn, strict=True))
        counts = self.plain.sizes(code)
        symbols = self.symbols.sizes(code)
        cut = np.flatnonzero((symbols > 0) & (gap < self.merges[code]))
        ids, n, _ = self._lockstep(self.symbols.flat, self.symbols.at[code[cut]], symbols[cut], state[cut], gap[cut])
        alone = np.concatenate([np.flatnonzero(symbols == 0), cut[n < 0]])
        lone = [np.frombuffer(self.chunk(chunks[i], int(state[i]))[0], np.int32) for i in alone.tolist()]
        # one pool of ids: plain ones, merged ones, those worked out alone; and where each occurrence reads
        pool = np.concatenate([self.plain.flat, ids, *lone])
        start = self.plain.at[code]
        n = np.maximum(n, 0)
        start[cut], counts[cut] = len(self.plain.flat) + np.cumsum(n) - n, n
        if lone:
            size = np.array([len(x) for x in lone], np.int64)
            start[alone], counts[alone] = len(self.plain.flat) + len(ids) + np.cumsum(size) - size, size
        ends = np.cumsum(counts)
        out = pool[np.repeat(start - (ends - counts), counts) + np.arange(ends[-1])]
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return [None if t is None else out[at[i]:at[i + 1]] for i, t in enumerate(texts)]

    def encode(self, text: str | None, key: int = 0) -> np.ndarray | None:
        """Ids of a text; ``key`` is its document's, from which the skips are drawn."""
        return self.encode_all([text], [key])[0]

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        ids = np.asarray(ids, np.int64)
        size = self.width[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.where[ids] - (ends - size), size)
        return self.blob[at].tobytes().decode()[1:]


def codec(model, options: tuple) -> Codec:
    """One codec for each worker process, so that its cache outlives a task. It
    is kept by ``sys``: this module may not be installed where the task runs."""
    held = vars(sys).setdefault("_piece_codecs", {})
    if (model, options) not in held:
        while len(held) > 1:
            del held[next(iter(held))]
        held[model, options] = Codec(model, **dict(options))
    return held[model, options]


def key_column(doc_id="doc_id", text="text") -> Column:
    """Key from which a document's skips are drawn: its id, or its text where the id is null."""
    return F.coalesce(F.xxhash64(F.col(doc_id)), F.xxhash64(F.col(text)))


def encode(docs: DataFrame, model=MODEL, **options) -> DataFrame:
    """doc_id, text, ids; one row per row."""
    def run(batches):
        c = codec(model, tuple(sorted(options.items())))
        for b in text_pieces(batches):
            ids = c.encode_all(b.column("text").to_pylist(), b.column("key").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "text", "ids"])
    rows = short_batches(docs).select(F.col("doc_id").cast("long"), "text").withColumn("key", key_column())
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model=MODEL) -> DataFrame:
    """doc_id, text decoded from ids; one row per row."""
    def run(batches):
        c = codec(model, ())
        for b in batches:
            lists = b.column("ids")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(x.values) if x.is_valid else None for x in lists], pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_decode(docs: DataFrame, model=MODEL, **options) -> DataFrame:
    """The columns of ``docs`` with text as decoded from the ids, and ids, n_ids, lossless."""
    names = [c for c in docs.columns if c not in ("ids", "n_ids", "lossless")]

    def run(batches):
        c = codec(model, tuple(sorted(options.items())))
        for b in text_pieces(batches):
            texts = b.column("text").to_pylist()
            ids = c.encode_all(texts, b.column("_key").to_pylist())
            back = [c.decode(x) for x in ids]
            new = [pa.array(ids, pa.list_(pa.int32())), pa.array([None if x is None else len(x) for x in ids], pa.int64()),
                   pa.array([a == d for a, d in zip(texts, back, strict=True)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(back, pa.string()) if x == "text" else b.column(k) for k, x in enumerate(names)), *new], names=[*names, "ids", "n_ids", "lossless"])
    rows = short_batches(docs).select(*names)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("ids array<int>, n_ids long, lossless boolean").fields])
    return neutral(rows).withColumn("_key", key_column()).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model=MODEL, **options) -> DataFrame:
    """doc_id, n_bytes, n_ids, ids_hash (xxhash64 of the ids as int32), lossless:
    every text encoded and the ids decoded again, in one pass."""
    def run(batches):
        c = codec(model, tuple(sorted(options.items())))
        for b in text_pieces(batches):
            out = {"n_bytes": [], "n_ids": [], "ids_hash": [], "lossless": []}
            texts = b.column("text").to_pylist()
            for text, ids in zip(texts, c.encode_all(texts, b.column("key").to_pylist()), strict=True):
                out["n_bytes"].append(len(text.encode()) if text is not None else 0)
                out["n_ids"].append(0 if ids is None else len(ids))
                out["ids_hash"].append(xxhash.xxh64_hexdigest(b"" if ids is None else ids.tobytes()))
                out["lossless"].append(c.decode(ids) == text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, out.values())], names=["doc_id", *out])
    rows = short_batches(docs).select(F.col("doc_id").cast("long"), "text").withColumn("key", key_column())
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_ids long, ids_hash string, lossless boolean")
