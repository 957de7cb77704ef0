"""Classifiers, rules and URL filter: held-out accuracy, brute force, edge rows."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortile.llm import langid, quality, rules, toxicity, urls
from cohortile.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, score double, keys string, letter string, n_words int, stratum string"
SF = "/root/testdata/sf0.1"
EDGES = [(1000, None), (1001, ""), (1002, " \n "), (1003, "12 .. 7"), (1004, "é"), (None, "hello there"), (1005, "word " * 60_000), (1006, "x"), (1006, "x")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, "k", "l", 1, "s") for i, t, lang in rows], SCHEMA)


def made_text(r, words, n):
    return " ".join(r.choice(words) + r.choice(["", "", ".", ","]) for _ in range(n))


LANGS = {"aa": ["the", "and", "thing", "ration", "other"], "bb": ["und", "schaft", "lich", "über", "weg"], "cc": ["que", "cion", "ñar", "los", "ado"]}


def test_language_id(spark):
    r = random.Random(3)
    rows = [(i, made_text(r, LANGS[x], r.randrange(8, 60)), x) for i, x in enumerate(r.choices(list(LANGS), k=240))]
    docs = table(spark, [*rows, *[(i, t, "aa") for i, t in EDGES], (2000, "lost label", None)])
    model = langid.fit(docs, Q.bucket(4) != 2, per_language=60)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    named = {x["doc_id"]: x for x in got}
    assert sum(named[i]["lang_pred"] == x for i, _, x in rows) > 0.97 * len(rows)
    for i in (1000, 1001, 1002, 1003):
        assert named[i]["lang_pred"] == "und" and named[i]["score"] == 0 and named[i]["rejected"]
    assert named[1004]["lang_pred"] != "und" and all(0 <= x["score"] <= 1 for x in got)
    kept = langid.accepted(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(not x["rejected"] for x in got)
    assert not any(named[i]["rejected"] for i, _, _ in rows)
    nothing = langid.fit(docs.limit(0), F.lit(True))
    assert {x["lang_pred"] for x in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_empty_training_rows_leave_rejection_on(spark):
    r = random.Random(12)
    rows = [(i, made_text(r, LANGS[x], r.randrange(30, 120)), x) for i, x in enumerate(r.choices(list(LANGS), k=240))]
    blank = [(3000 + k, t, x) for k, (t, x) in enumerate((t, x) for x in LANGS for t in ["", " \n ", "12 .. 7", "a"])]
    noise = [(4000 + k, " ".join("".join(chr(r.randrange(*span)) for _ in range(6)) for _ in range(60)), None) for k in range(20) for span in [(0x4E00, 0x9000), (0x0400, 0x0450)]]
    noise += [(5000 + k, "".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(600)), None) for k in range(20)]
    docs = table(spark, [*rows, *blank, *noise])
    model = langid.fit(docs, F.lit(True))
    assert all(np.linalg.norm(c) > 0.99 for c in model["centers"]) and (model["radius"] < 0.99).all()
    got = {x["doc_id"]: x for x in langid.predict(docs, model).collect()}
    assert all(got[i]["rejected"] for i, _, _ in noise)
    assert all(not got[i]["rejected"] and got[i]["lang_pred"] == x for i, _, x in rows)
    letters = langid.fit(table(spark, [(1, "a", "aa"), (2, "b", "bb")]), F.lit(True))
    assert langid.predict(docs, letters).filter("not rejected").count() == 0


def test_document_frequency_counts_each_text_once(spark):
    texts = ["abc abc", "abc", None, "zzz"]
    got = {x["dim"]: x["df"] for x in langid.document_frequency(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    each = [langid.gram_counts(pa.array([t], pa.string()))[0] > 0 for t in texts]
    assert got[-1] == 4 and all(got[k] == sum(e[k] for e in each) for k in range(langid.DIMS))


def test_toxicity(spark):
    r = random.Random(5)
    clean, bad = [f"w{k}" for k in range(300)], ["scum", "trash"]
    rows, labels = [], []
    for i in range(500):
        y = int(r.random() < 0.3)
        words = [r.choice(clean) for _ in range(r.randrange(3, 40))]
        if y:
            words.insert(r.randrange(len(words)), r.choice(bad).upper())
        rows.append((i, " ".join(words), "en"))
        labels.append((i, y))
    docs = table(spark, [*rows, *[(i, t, "en") for i, t in EDGES]])
    marks = spark.createDataFrame([*labels, (0, labels[0][1]), (7, None), (99999, 1), (None, 1)], "doc_id long, label int")
    model = toxicity.fit(docs.filter(Q.bucket(5) != 0), marks)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got)
    named = {x["doc_id"]: x["score"] for x in got}
    assert sum((named[i] >= 0.5) == y for i, y in labels) > 0.97 * len(labels)
    assert named[1000] == named[1001] == named[1002] < 0.5 and len(model["slots"]) < 2000
    untrained = toxicity.fit(docs, marks.limit(0))
    assert {x["score"] for x in toxicity.score(docs, untrained).collect()} == {0.5}


def test_ftrl_gradient_step_by_hand():
    w, b = toxicity.ftrl([np.array([3])], np.array([1.0]), bits=4, alpha=0.5, beta=1.0, l1=0.1, l2=0.0, epochs=1, positive=1.0)
    z, n = -0.5, 0.25
    assert w[3] == b == pytest.approx(-(z + 0.1) / ((1 + math.sqrt(n)) / 0.5)) and (w != 0).sum() == 1


def test_quality(spark):
    r = random.Random(6)
    words = [[f"low{k}" for k in range(40)], [f"mid{k}" for k in range(40)], [f"top{k}" for k in range(40)]]
    rows = [(i, " ".join(r.choice(words[i % 3]) for _ in range(20)), "en") for i in range(300)]
    docs = table(spark, [*rows, *[(i, t, "en") for i, t in EDGES]])
    grades = spark.createDataFrame([*[(i, i % 3) for i in range(300)], (0, 2), (5, None)], "doc_id long, grade int")
    model = quality.fit(docs.filter(Q.bucket(5) != 0), grades)
    assert list(model["theta"]) == sorted(model["theta"]) and len(model["theta"]) == 2
    got = {x["doc_id"]: x for x in quality.score(docs, model, at_least=2).collect()}
    means = [np.mean([got[i]["expected_grade"] for i in range(g, 300, 3)]) for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.5 < means[2]
    assert np.mean([got[i]["p_tail"] > 0.5 for i in range(2, 300, 3)]) > 0.95 and got[1000]["p_tail"] == got[1001]["p_tail"]
    assert quality.score(docs, quality.fit(docs, grades.limit(0))).count() == docs.count()


@pytest.mark.parametrize("name,label", [("op2_toxicity", "toxic"), ("op4_quality", "quality")])
def test_held_out_on_given_tables(spark, name, label):
    out = Q.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    verdict = F.col("predicted") if name == "op2_toxicity" else F.col("selected").cast("int")
    x = out.agg(F.avg((verdict == F.col(label)).cast("double")).alias("right"), F.avg(F.when(F.col(label) == 1, verdict)).alias("recall"),
                F.avg(F.when(F.col(label) == 0, verdict)).alias("false")).first()
    assert x["right"] > 0.93 and x["recall"] > 0.7 and x["false"] < 0.35


def test_language_on_given_tables(spark):
    out = Q.QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    x = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.avg(F.col("rejected").cast("double")).alias("lost")).first()
    assert x["right"] > 0.95 and x["lost"] < 0.005


def py_counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = {}
    for k in range(len(w) - 2):
        windows.setdefault(tuple(w[k:k + 3]), []).append(k)
    hit = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rule_counts(spark):
    r = random.Random(9)
    texts = [t for _, t in EDGES] + ["a b c a b c", "a b a b a", "x\nx\n\n \nx y\nx", "## $$ | <b> é*", "\n", "a b c d e a b c d e a b", " ".join(r.choice("abcd") for _ in range(400)), "ab c a bc a b c"]
    got = rules.features(table(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert {x["doc_id"]: tuple(x[c] for c in names) for x in got} == {i: py_counts(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (0, 1), (3, 400), (10, 1000), (100, 10_000), (200, 10_000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for x in got:
        want = sum(Fraction(math.comb(x["n"], j)) * Fraction(1, 100) ** j * Fraction(99, 100) ** (x["n"] - j) for j in range(x["k"] + 1))
        assert x["p"] == pytest.approx(float(want) if x["k"] <= x["n"] * 0.01 else 1.0, rel=1e-9)


def test_thresholds_hold_the_risk(spark):
    r = random.Random(1)
    clean = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(60))
    dirty = lambda: " ".join(f"w{r.randrange(900)}###" for _ in range(60))
    rows = [(20_000 + i, clean() if i % 4 else dirty(), "en" if i < 1600 else None) for i in range(1700)]
    docs = table(spark, [*rows, *[(i, t, "en") for i, t in EDGES]])
    labels = spark.createDataFrame([*[(20_000 + i, int(i % 4 > 0)) for i in range(1700)], (20_000, 0), (20_004, None), (55555, 1)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in rules.apply(docs, labels, alpha=0.03).collect()}
    assert all(got[20_000 + i]["kept"] for i in range(1600) if i % 4) and not any(got[20_000 + i]["kept"] for i in range(0, 1600, 4))
    assert got[20_000]["rejected_by"] == "symbols"
    assert all(got[20_000 + i]["kept"] for i in range(1600, 1700))  # too few labels: nothing is rejected
    assert got[1000]["base_failed"] and not got[1000]["kept"]
    assert rules.apply(docs, labels.limit(0)).filter("not kept and not base_failed").count() == 0
    assert rules.apply(docs.limit(0), labels).count() == 0
    plan = rules.apply(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def py_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host):])[0]


def test_urls(spark):
    cases = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.COM/en/a?x#y", "http://example.com/en", "http://example.com/en/", "https://a.b.net/es/1", "http://net/fr/",
             "http://xnet/fr/2", "ftp://É.org?q=http://example.com/en/", "http://a\nb.com/en/\n1", "http://deep.www.example.com/en/#z", "http://com", "http://com/", "x://y://com/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(cases)] + [(None, "http://example.com/en/", "h", "p"), (3, "http://", "h", "p")], "page_id long, url string, host string, path string")
    model = urls.fit(spark.createDataFrame([*urls.SEED_URLS, (None, 1), ("http://x.org/", None), urls.SEED_URLS[0]], "url string, label int"))
    got = urls.judge(pages, Q.RULES, model).collect()
    assert len(got) == len(cases) + 2
    for x in got:
        host, path = py_parts(x["url"])
        fits = [(len(h + p), h + p, v) for h, p, v in Q.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else None
        assert (x["host"], x["path"], x["rule"]) == (host, path, best and best[1])
        assert x["verdict"] == (best[2] if best else "block" if x["score"] > 0.5 else "allow")
    seeds = urls.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls.SEED_URLS)], "page_id long, url string"), [], model).collect()
    assert all((x["verdict"] == "block") == bool(urls.SEED_URLS[x["page_id"]][1]) for x in seeds)
    empty = urls.fit(spark.createDataFrame([], "url string, label int"))
    assert {x["score"] for x in urls.judge(pages, [], empty).collect()} == {0.5}
    assert urls.judge(pages.limit(0), Q.RULES, model).count() == 0
