"""Removal of long repeated passages with a logarithmic family of suffix arrays.

A byte goes if a ``width``-byte string over it also starts in a document with a
smaller id. Suffixes are sampled and sharded by content: the smallest hash of
the ``gram``-byte strings inside a width-byte window is the window's key, so
equal windows have equal keys anywhere. Neighbouring windows with one key are a
segment, about one for 14 bytes.

1. Every piece of text sends its distinct keys; the shard of a key says which
   of them another document has. Only segments with such keys go on.
2. Their bytes go to the shard of the key. There documents come in batches of
   rising id. A batch gets its suffix array (the suffixes that start in it, in
   byte order, cut to the width), is merge-scanned against every level for
   matches of the whole width, and becomes the smallest level; levels of equal
   size merge, so a shard of n windows has at most log n levels and moves a
   window log n times.
3. Removed spans return to the documents.

Matches in a shard compare bytes. Inside a piece equal segments are told by a
64-bit hash.

Skew: a piece sends one entry per distinct key and one per distinct segment. What
repeats inside the piece is decided there, so a passage in a third of all
documents puts as many entries in its shard as there are pieces. Shards and
pieces follow ``spark.sql.shuffle.partitions`` and the input's size.

Defined cases: null or empty text has no bytes. A null id counts as greater than
all others. Rows with the same id never remove from each other. Texts shorter
than ``width`` lose nothing. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, durable
from .text import M2, M3, flat, give_back, mix, neutral, pieces, powers, prefix_sums, short_batches, span_hashes

WIDTH = 50
GRAM = 24
BATCH = 1 << 16
#: larger pieces repeat less of what many documents share
CHUNK_BYTES = (1 << 21) - 64
LAST_ID = (1 << 63) - 1
LOW = np.uint64((1 << 40) - 1)
PACKET = "route long, kind int, chunk long, a binary, b binary, c binary, d binary, e binary"
NAMES = [x.split()[0] for x in PACKET.split(", ")]
SCHEMA = pa.schema([("route", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), *((x, pa.binary()) for x in "abcde")])


def segments(data: np.ndarray, offs: np.ndarray, width=WIDTH, gram=GRAM):
    """Start, number of windows, key and text number of the segments, and the prefix sums of the bytes."""
    sums = prefix_sums(data)
    if len(data) < width:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, sums
    m = mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][:len(sums) - gram])
    step, reach = 1, width - gram + 1
    while step * 2 <= reach:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if reach > step:
        m = np.minimum(m[:step - reach], m[reach - step:])
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:len(m)]
    at = np.flatnonzero(np.arange(len(m)) + width <= offs[1:][doc])
    m, doc = m[at], doc[at]
    first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else at
    return at[first], np.diff(np.append(first, len(at))), m[first], doc[first], sums


def packet(route, kind, chunk, *arrays):
    return [int(route), kind, int(chunk), *[x.tobytes() for x in arrays], *[b""] * (5 - len(arrays))]


def batch_of(rows):
    cols = zip(*rows, strict=True) if rows else [[]] * len(SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA, strict=True)], schema=SCHEMA)


def array(table, column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(column).to_pylist()]


def keys_of(batch):
    """Ids and prints of the piece, and a number that names it: a re-run of the task names it alike."""
    ids, prints = (np.asarray(batch.column(c)).astype(np.int64) for c in ("id", "print"))
    order = np.arange(len(ids), dtype=np.uint64) * M2
    name = mix(ids.view(np.uint64) * M3 + mix(prints.view(np.uint64) + order)).sum(dtype=np.uint64)
    return ids, prints, np.array([name], np.uint64).view(np.int64)[0]


def by_shard(key, shards):
    """Order of the entries by shard, and the runs (shard, from, to)."""
    shard = ((key >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    return order, [(s, cut[s], cut[s + 1]) for s in np.flatnonzero(np.diff(cut))]


def ask_keys(shards, width, gram):
    """Step 1, in a piece: its distinct keys to their shards; its documents and locally shared keys to itself."""
    def run(batches):
        for b in pieces(batches, limit=CHUNK_BYTES):
            ids, prints, chunk = keys_of(b)
            data, offs = flat(b.column("text"))
            _, _, key, doc, _ = segments(data, offs, width, gram)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
            local = np.repeat(many, np.diff(np.append(first, len(key))))
            rows = [packet(int(chunk) % shards, 1, chunk, ids, prints, doc[local].astype(np.uint16), key[local] & LOW)]
            key, owner = key[first], np.where(many, 0xFFFF, doc[first]).astype(np.uint16)
            order, runs = by_shard(key, shards)
            key, owner = key[order] & LOW, owner[order]
            for s, lo, hi in runs:
                k = key[lo:hi]
                rows.append(packet(s, 0, chunk, k.astype(np.uint32), (k >> np.uint64(32)).astype(np.uint8), owner[lo:hi]))
            yield batch_of(rows)
    return run


def answer_keys(t: pa.Table) -> pa.Table:
    """Step 1, in a shard: which single-document keys of a piece stand in another piece."""
    t = t.combine_chunks()
    asked, own = t.filter(pc.equal(t["kind"], 0)), t.filter(pc.equal(t["kind"], 1))
    low, high, owner = array(asked, "a", np.uint32), array(asked, "b", np.uint8), array(asked, "c", np.uint16)
    out = []
    if low:
        size = np.array([len(x) for x in low])
        key = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
        source, owner = np.repeat(np.arange(len(size)), size), np.concatenate(owner)
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        yes = np.flatnonzero((count[back] > 1) & (owner != 0xFFFF))
        cut = np.searchsorted(source[yes], np.arange(len(size) + 1))
        chunks = asked.column("chunk").to_pylist()
        for i in np.flatnonzero(np.diff(cut)):
            pick = yes[cut[i]:cut[i + 1]]
            out.append(packet(0, 0, chunks[i], owner[pick], key[pick]))
    return pa.concat_tables([own.select(NAMES).cast(SCHEMA), pa.Table.from_batches([batch_of(out)])])


def keys_by_document(t: pa.Table) -> pa.Table:
    """Step 1, back in the piece: id, print, sorted shared keys of every document that has some."""
    own, got = t.filter(pc.equal(t["kind"], 1)), t.filter(pc.equal(t["kind"], 0))
    ids, prints = array(own, "a", np.int64)[0], array(own, "b", np.int64)[0]
    doc = np.concatenate([array(own, "c", np.uint16)[0], *array(got, "a", np.uint16)]).astype(np.uint64)
    key = np.concatenate([array(own, "d", np.uint64)[0], *array(got, "b", np.uint64)])
    code = np.unique((doc << np.uint64(40)) | key)
    doc = (code >> np.uint64(40)).astype(np.int64)
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    some = np.flatnonzero(np.diff(cut))
    return pa.table({"id": ids[some], "print": prints[some], "keys": pa.array([(code[cut[i]:cut[i + 1]] & LOW).tobytes() for i in some], pa.binary())})


def send_segments(shards, width, gram):
    """Step 2, in a piece: shared segments to their shards, one for equal bytes; the later copies go at once."""
    def run(batches):
        for b in pieces(batches, limit=CHUNK_BYTES):
            ids, prints, chunk = keys_of(b)
            data, offs = flat(b.column("text"))
            start, n, key, doc, sums = segments(data, offs, width, gram)
            sets = [np.frombuffer(x, np.uint64) for x in b.column("keys").to_pylist()]
            codes = np.concatenate([x | (np.uint64(i) << np.uint64(40)) for i, x in enumerate(sets)])
            code = (key & LOW) | (doc.astype(np.uint64) << np.uint64(40))
            spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            pick = np.flatnonzero(codes[spot] == code)
            start, n, key, doc = start[pick], n[pick], key[pick], doc[pick]
            end = start + n + width - 1
            same = span_hashes(sums, start, end)
            order = np.lexsort((ids[doc], same))
            new = np.concatenate([[True], same[order][1:] != same[order][:-1]]) if len(order) else np.zeros(0, bool)
            least = ids[doc[order]][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
            later = np.zeros(len(order), bool)
            later[order] = ids[doc[order]] > least
            place = (start - offs[doc]).astype(np.int64)
            rows = [packet(int(chunk) % shards, 1, chunk, ids, prints, doc[later].astype(np.uint16), place[later], (place + end - start)[later])]
            keep = np.flatnonzero(~later)
            order, runs = by_shard(key[keep], shards)
            keep = keep[order]
            for s, lo, hi in runs:
                k = keep[lo:hi]
                blob = np.concatenate([data[start[i]:end[i]] for i in k])
                rows.append(packet(s, 0, chunk, doc[k].astype(np.uint16), ids[doc[k]], place[k], n[k].astype(np.uint32), blob))
            yield batch_of(rows)
    return run


class Family:
    """Suffix arrays of geometric sizes. An array holds the sampled suffixes, cut
    to the window's width, in byte order, each distinct one once with the least
    id that has it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Adds a batch (ids not below any earlier one); True where a smaller id has the window.

        ``windows`` has the bytes of a window in each row. Their order is the
        batch's suffix array; neighbours that agree over the whole width are one
        suffix. The array is merge-scanned against every level: both are in byte
        order, so each suffix's place in the level is found going forward, and a
        match is a suffix there with the same bytes.
        """
        text = np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel()
        order = np.argsort(text, kind="stable")
        array_, owner = text[order], ids[order]
        first = np.concatenate([[True], array_[1:] != array_[:-1]])
        run = np.cumsum(first) - 1
        suffix, least = array_[first], owner[first]  # ids rise, so the first of a run has the least
        known = np.zeros(len(suffix), bool)
        for x, z in self.levels:
            spot = np.minimum(np.searchsorted(x, suffix), len(x) - 1)
            match = x[spot] == suffix
            known |= match
            least = np.where(match, np.minimum(least, z[spot]), least)
        out = np.empty(len(ids), bool)
        out[order] = owner > least[run]
        if not known.all():
            self.levels.append((suffix[~known], least[~known]))
        while len(self.levels) > 1 and len(self.levels[-1][0]) * 2 > len(self.levels[-2][0]):
            self.levels.append(self._merged(self.levels.pop(), self.levels.pop()))
        return out

    @staticmethod
    def _merged(small, large):
        """Two arrays without common suffixes as one, in order."""
        (x, p), (y, q) = small, large
        at = np.searchsorted(y, x) + np.arange(len(x))
        here = np.zeros(len(x) + len(y), bool)
        here[at] = True
        suffix, ids = np.empty(len(here), y.dtype), np.empty(len(here), np.int64)
        suffix[here], suffix[~here], ids[here], ids[~here] = x, y, p, q
        return suffix, ids


def judge_segments(width, batch=BATCH):
    """Step 2, in a shard: batches of rising ids against the family; removed spans return to the pieces."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sent, own = t.filter(pc.equal(t["kind"], 0)), t.filter(pc.equal(t["kind"], 1))
        out = []
        if sent.num_rows:
            doc, ids, place, n = (array(sent, c, d) for c, d in zip("abcd", (np.uint16, np.int64, np.int64, np.uint32), strict=True))
            source = np.repeat(np.arange(len(doc)), [len(x) for x in doc])
            doc, ids, place, n = np.concatenate(doc), np.concatenate(ids), np.concatenate(place), np.concatenate(n).astype(np.int64)
            blob = np.concatenate(array(sent, "e", np.uint8))
            base = np.concatenate([[0], np.cumsum(n + width - 1)])[:-1]
            order = np.argsort(ids, kind="stable")
            hit_entry, hit_at, family = [], [], Family()
            cut = np.concatenate([[0], np.cumsum(n[order])])
            edges = [0, *np.unique(np.searchsorted(cut, np.arange(batch, cut[-1] + batch, batch))).clip(0, len(order))]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = order[lo:hi]
                if not len(part):
                    continue
                entry = np.repeat(part, n[part])
                at = np.arange(len(entry)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                size = n[part] + width - 1
                fresh = np.concatenate([[0], np.cumsum(size)])[:-1]
                local = np.concatenate([blob[base[i]:base[i] + n[i] + width - 1] for i in part])
                first = np.repeat(fresh, n[part]) + at
                found = family.scan(np.lib.stride_tricks.sliding_window_view(local, width)[first], ids[entry])
                hit_entry.append(entry[found])
                hit_at.append(at[found])
            entry, at = np.concatenate(hit_entry), np.concatenate(hit_at)
            if len(entry):
                new = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (at[1:] != at[:-1] + 1)]))
                last = np.append(new[1:], len(entry)) - 1
                e, begin, end = entry[new], place[entry[new]] + at[new], place[entry[new]] + at[last] + width
                order = np.argsort(source[e], kind="stable")
                cuts = np.searchsorted(source[e][order], np.arange(sent.num_rows + 1))
                chunks = sent.column("chunk").to_pylist()
                for i in np.flatnonzero(np.diff(cuts)):
                    pick = order[cuts[i]:cuts[i + 1]]
                    out.append(packet(0, 0, chunks[i], doc[e[pick]], begin[pick], end[pick]))
        give_back()
        return pa.concat_tables([own.select(NAMES).cast(SCHEMA), pa.Table.from_batches([batch_of(out)])])
    return run


def spans_by_document(t: pa.Table) -> pa.Table:
    """Step 3, back in the piece: id, print, joined removed spans of every document that loses some."""
    own, got = t.filter(pc.equal(t["kind"], 1)), t.filter(pc.equal(t["kind"], 0))
    ids, prints = array(own, "a", np.int64)[0], array(own, "b", np.int64)[0]
    doc = np.concatenate([array(own, "c", np.uint16)[0], *array(got, "a", np.uint16)]).astype(np.int64)
    begin = np.concatenate([array(own, "d", np.int64)[0], *array(got, "b", np.int64)])
    end = np.concatenate([array(own, "e", np.int64)[0], *array(got, "c", np.int64)])
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    some, starts, ends = np.flatnonzero(np.diff(cut)), [], []
    for i in some:
        b, e = begin[cut[i]:cut[i + 1]], np.maximum.accumulate(end[cut[i]:cut[i + 1]])
        new = np.concatenate([[True], b[1:] > e[:-1]])
        starts.append(b[new].tolist())
        ends.append(e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)].tolist())
    return pa.table({"id": ids[some], "print": prints[some], "starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64()))})


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).withColumn("print", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, width=WIDTH, gram=GRAM, batch=BATCH) -> DataFrame:
    """id, print (of the text), starts, ends: the byte spans that a document loses; one row for each that loses some."""
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(short_batches(docs).select("doc_id", "text")).select("id", "print", "text").filter(F.octet_length("text") >= width)
    asked = texts.mapInArrow(ask_keys(shards, width, gram), PACKET).groupBy("route").applyInArrow(answer_keys, PACKET)
    shared = asked.groupBy("chunk").applyInArrow(keys_by_document, "id long, print long, keys binary")
    shared = durable(shared.dropDuplicates(["id", "print"]))
    # a merge join leaves the rows sorted, so a re-run cuts the same pieces
    again = texts.join(shared.hint("merge"), ["id", "print"]).select("id", "print", "text", "keys")
    sent = again.mapInArrow(send_segments(shards, width, gram), PACKET).groupBy("route").applyInArrow(judge_segments(width, batch), PACKET)
    spans = sent.groupBy("chunk").applyInArrow(spans_by_document, "id long, print long, starts array<long>, ends array<long>")
    spans = durable(spans.dropDuplicates(["id", "print"]))
    discard(shared)
    return spans


def _with_spans(docs: DataFrame, width, gram, batch) -> DataFrame:
    """docs with starts and ends of the spans they lose (null: none)."""
    spans = repeated_spans(docs, width, gram, batch).select(F.col("id").alias("_id"), F.col("print").alias("_print"), "starts", "ends")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.join(spans, (key == F.col("_id")) & (F.xxhash64("text") == F.col("_print")), "left").drop("_id", "_print")


def _kept(batch) -> list[tuple[bytes, bytes, list, list]]:
    """Bytes, bytes left, starts and ends of the texts of a piece."""
    data, offs = flat(batch.column("text"))
    out = []
    for i, (s, e) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
        body, s, e = data[offs[i]:offs[i + 1]].tobytes(), s or [], e or []
        out.append((body, b"".join(body[x:y] for x, y in zip([0, *e], [*s, len(body)], strict=True)) if s else body, s, e))
    return out


def remove(docs: DataFrame, width=WIDTH, gram=GRAM, batch=BATCH) -> DataFrame:
    """The columns of ``docs`` (without those named like the new ones) and n_bytes,
    n_removed, starts, ends, kept (binary: the bytes left), kept_sha256; one row per row."""
    new = T.StructType.fromDDL("n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary, kept_sha256 string")
    rows = docs.drop(*new.names, "_id", "_print")
    names = rows.columns

    def cut(batches):
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string()]
        for b in pieces(batches):
            out = [(len(body), len(body) - len(kept), s, e, kept, hashlib.sha256(kept).hexdigest()) for body, kept, s, e in _kept(b)]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *arrays], names=[*names, *new.names])

    return _with_spans(rows, width, gram, batch).mapInArrow(cut, T.StructType([*rows.schema.fields, *new.fields]))


def without_repeats(docs: DataFrame, width=WIDTH, gram=GRAM) -> DataFrame:
    """The columns of ``docs`` with text cut to the bytes left. Where a cut goes
    through a character of several bytes, the rest of that character goes too."""
    names, schema = docs.columns, docs.schema

    def cut(batches):
        for b in pieces(batches):
            null = b.column("text").is_null().to_pylist()
            text = pa.array([None if n else kept.decode("utf-8", "ignore") for n, (_, kept, _, _) in zip(null, _kept(b), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else b.column(k) for k, c in enumerate(names)], names=names)

    return _with_spans(neutral(docs), width, gram, BATCH).mapInArrow(cut, schema)
