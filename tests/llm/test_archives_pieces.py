"""WARC bundles, piece codec, pipeline and the guard of the entry file."""

import base64
import hashlib
import os
import random
import shutil
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

import corpus_pipeline
from cohortile.llm import jaccard, pieces, warc

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PAGES = [(1, "http://a.org/1", "<p>é</p>"), (2, "http://a.org/2", "<p>é</p>"), (3, "u v\r\nX: y", ""), (4, None, None), (5, "http://b", "long " * 50_000), (6, "x", "WARC/1.1\r\n\r\n"),
         (7, "x", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "m", "only null"), (None, "m", "only null"), (8, "http://c", "twice"), (8, "http://c", "twice")]


def read_all(spark, pages, folder, **options):
    index = warc.write(pages, folder, **options)
    return index, warc.read(spark, index).collect()


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1, "d") for r in PAGES], "page_id long, url string, html string, size int, sha string").repartition(3)
    for n, least in enumerate((0, 6, 10**9)):
        index, got = read_all(spark, pages, f"{tmp_path}/{n}", min_bytes=least, frame_bytes=300, bundle_bytes=4000)
        assert len(got) == len(PAGES) and all(x["intact"] for x in got)
        best = {}
        for page, _, html in PAGES:
            body = (html or "").encode()
            if page is not None and len(body) >= least:
                best[body] = max(page, best.get(body, page))
        want = []
        for page, _, html in PAGES:
            body = (html or "").encode()
            other = best.get(body) if len(body) >= least and best.get(body) != page else None
            want.append((str(page), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if other else "response", str(other)))
        assert sorted((str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], str(x["refers_to"])) for x in got) == sorted(want)
    for x in index.collect():
        record = warc.read_record(x["bundle"], x["frame"], x["offset"], x["length"])
        assert [f["WARC-Record-ID"] for f, _ in warc.parse(record)] == [f"<{x['record_id']}>"]
    assert {x["url"] for x in got if x["page_id"] == 3} == {"u%20v%0D%0AX:%20y"}


def test_bundle_is_plain_zstandard(spark, tmp_path):
    import zstandard

    index, _ = read_all(spark, spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/z", frame_bytes=100)
    uri = index.first()["bundle"]
    where, path = fs.FileSystem.from_uri(uri)
    data = where.open_input_file(path).read()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(list(warc.parse(plain))) == index.filter(index.bundle == uri).count()


def test_warc_of_no_pages(spark, tmp_path):
    index, got = read_all(spark, spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/none")
    assert got == [] and index.count() == 0


needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no piece model")
TEXTS = ["", " ", "  a  b ", "Hello  world é\n x", "▁x a▁▁b ▁", "一😀\x00 q", "<0x41> <s>", "a", "\n", "tab\tx", None, "   ", "\n\n  \n", "x" * 500, "thththe " * 900]


@needs_model
def test_codec():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain, drop = pieces.Codec(dropout=0.0), pieces.Codec(dropout=0.3, variants=3)
    for t in TEXTS:
        ids = plain.encode(t)
        assert plain.decode(ids) == t
        if t and "▁" not in t:
            assert ids.tolist() == sp.encode(t)
        for key in range(4):
            assert drop.decode(drop.encode(t, key)) == t
    t = TEXTS[-1]
    assert len(drop.encode(t)) > len(plain.encode(t))
    assert drop.encode(t, 0).tolist() == pieces.Codec(dropout=0.3, variants=3).encode(t, 0).tolist() != drop.encode(t, 1).tolist()
    assert pieces.Codec(dropout=0.3, variants=3, seed=2).encode(t).tolist() != drop.encode(t).tolist()
    assert pieces.Codec(dropout=0.3, variants=3, cache=30).encode(t).tolist() == drop.encode(t).tolist()
    assert len(pieces.Codec(dropout=1.0).encode("hello")) == 6


@needs_model
def test_agendas_agree():
    c, r = pieces.Codec(dropout=0.2), random.Random(2)
    for _ in range(400):
        w = "".join(r.choice("thingséo▁.x") for _ in range(r.randrange(1, 40)))
        base, a = r.getrandbits(64), [c.chars.get(x, c.none + (1 << 22)) for x in w]
        b, at, bt = list(a), list(range(len(a))), list(range(len(a)))
        c._scan(a, at, base)
        c._heap(b, bt, base)
        assert (a, at) == (b, bt)


def by_coin(codec, word, r, dropout):
    """Ids of a word when a coin is thrown for each candidate merge that comes up."""
    parts, gone = [codec.chars[x] for x in word.replace(" ", pieces.MARK)], set()
    at = list(range(len(parts)))
    while True:
        ranks = [(codec.merge.get(a << 24 | b), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
        ranks = [(m, k) for m, k in ranks if m is not None and (m, at[k]) not in gone]
        if not ranks:
            return [codec.ids[x] for x in parts]
        m, k = min(ranks)
        if r.random() < dropout:
            gone.add((m, at[k]))
        else:
            parts[k:k + 2], at[k:k + 2] = [m], [at[k]]


@needs_model
def test_every_occurrence_draws_its_own_skips():
    word, n, r = " internationalisation", 3000, random.Random(8)
    c, plain = pieces.Codec(dropout=0.1), pieces.Codec(dropout=0.0)

    def cuts(text, key):
        out = []
        for i in c.encode(text, key).tolist():
            if c.bytes[i].startswith(b" "):
                out.append([])
            out[-1].append(i)
        return [tuple(x) for x in out]

    whole = plain.encode(word[1:]).tolist()
    merges = len(word) - len(whole)
    got = cuts((word * n)[1:], 7)
    assert len(got) == n and len(set(got)) > 20
    _, gaps = c.draws([word] * n, 7)
    assert abs((gaps >= merges).mean() - 0.9 ** merges) < 0.03
    assert abs(sum(list(x) == whole for x in got) / n - sum(by_coin(plain, word, r, 0.1) == whole for _ in range(n)) / n) < 0.05
    assert len({cuts("international", key)[0] for key in range(200)}) > 5
    # the cache never shows: every occurrence worked out alone gives the same ids
    for codec in (c, pieces.Codec(dropout=0.1, cache=4), pieces.Codec(dropout=1e-3)):
        chunks = codec.split(" the other thing" + word * 200 + " " + "th" * 300)
        state, gaps = codec.draws(chunks, 3)
        assert codec.encode("".join(chunks)[1:], 3).tobytes() == b"".join(codec.chunk(x, s)[0] for x, s in zip(chunks, state.tolist()))
        assert gaps.tolist() == [codec.gap(s, 0) for s in state.tolist()]


@needs_model
def test_lockstep_equals_the_agenda_of_each_occurrence():
    """10^5 occurrences of random chunks, with characters in and out of the vocabulary, under several dropouts."""
    r = random.Random(11)
    letters = "etaoinshrdlu" * 4 + "ABCéß.,-'▁漢字😀ø0123"
    words = [" " * r.randrange(0, 3) + "".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 21, 34, 47, 60]))) for _ in range(4000)]
    for dropout, n in ((0.1, 60_000), (0.5, 20_000), (1e-3, 20_000), (1.0, 2000)):
        c = pieces.Codec(dropout=dropout)
        text = "".join(r.choice(words) for _ in range(n // 3)) + "x"
        chunks = c.split(" " + text)
        state, _ = c.draws(chunks, 5)
        want = b"".join(c.chunk(x, s)[0] for x, s in zip(chunks, state.tolist()))
        assert c.encode(text, 5).tobytes() == want
        assert c.decode(c.encode(text, 5)) == text
    many = pieces.Codec(dropout=0.1)
    texts = [None, "", *words[:50], "a " * 200]
    for got, t, k in zip(many.encode_all(texts, range(len(texts))), texts, range(len(texts))):
        assert got is None if t is None else got.tolist() == pieces.Codec.encode(many, t, k).tolist()


@needs_model
def test_codec_on_tables(spark):
    rows = [(i, t, 5, "k") for i, t in enumerate(TEXTS)] + [(None, "no id", 5, "k"), (1, " ", 5, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, key string")
    encoded = pieces.encode(docs)
    assert sorted(map(str, (x["text"] for x in pieces.decode(encoded).collect()))) == sorted(str(r[1]) for r in rows)
    trip = pieces.round_trip(docs).collect()
    assert len(trip) == len(rows) and all(x["lossless"] for x in trip)
    both = pieces.encode_decode(docs)
    assert both.columns == ["doc_id", "text", "key", "ids", "n_ids", "lossless"] and all(x["lossless"] for x in both.collect())
    codec = pieces.Codec()
    keys = docs.select("doc_id", "text", pieces.key_column().alias("k")).collect()
    want = {(x["doc_id"], x["text"]): None if x["text"] is None else codec.encode(x["text"], x["k"]).tolist() for x in keys}
    assert all(x["ids"] == want[x["doc_id"], x["text"]] for x in encoded.collect())
    assert pieces.encode_decode(docs.limit(0)).count() == pieces.round_trip(docs.limit(0)).count() == 0


@needs_model
def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(["the", "and", "ration", "other", "thing"]) + str(r.randrange(500)) for _ in range(n))
    passage, item = text(60), text(30)
    rows = [(k, text(r.randrange(30, 90)), "en", "s", 1) for k in range(60)]
    rows += [(100, rows[3][1] + " end", "en", "s", 1), (101, rows[4][1], "en", "s", 1)]  # copies
    rows += [(110, text(50) + " " + passage + " " + text(20), "en", "s", 1), (111, text(70) + " " + passage + " " + text(9), "en", "s", 1)]
    rows += [(120, text(20) + " " + item, "en", "s", 1), (130, None, "en", "s", 1), (131, "123 ... 9", None, None, None), (132, "", "en", "s", 0)]
    rows += [(140, text(40), None, None, None), rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(60), 110, 111, 140}
    assert all(x["lossless"] and x["n_chars"] == len(x["text"]) for x in out.values())
    assert passage in out[110]["text"] and passage[30:-30] not in out[111]["text"]
    assert out[3]["text"] == rows[3][1]
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_entry_works_without_this_folder(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(k.startswith('op1_') or k == 'pipeline' for k in e.queries()); print('fine')"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
    assert said.stdout.strip() == "fine", said.stderr
    (tmp_path / "repo/corpus_pipeline.py").write_text("import missing_module_of_its_own")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert "missing_module_of_its_own" in said.stderr


def test_jaccard_sketch_rows_are_stable():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3]), "text": pa.array(["a b c d e f g h i", None, "a b c d e f g h i"])})
    one, two = (list(jaccard.sketch(5)([batch])) for _ in range(2))
    assert one[0].equals(two[0])
    assert np.frombuffer(one[0]["sizes"][0].as_py(), np.int64).tolist() == [5, 0, 5]
