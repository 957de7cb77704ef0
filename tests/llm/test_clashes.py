"""Every pipeline stage on documents whose other columns clash with inner names; cutoffs that act; archives on many tasks."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortile.llm import queries as Q
from cohortile.llm import rules, warc

SF = "/root/testdata/sf0.001"
CLASHES = ["_id", "_print", "_key", "_letter", "_other3", "_text", "node", "words", "key", "last", "starts", "hash", "component", "print", "sig", "row", "batch"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_keeps_clashing_columns(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    plain = {r["doc_id"]: r["text"] for r in stage(spark, docs, SF).collect()}
    out = stage(spark, more, SF)
    assert out.columns[:len(more.columns)] == more.columns
    got = out.collect()
    assert {r["doc_id"]: r["text"] for r in got} == plain
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES)


def test_cutoffs_act_on_the_given_tables(spark):
    """At sf0.1 rules reject documents that the base rules let pass, and lose no labelled good share above alpha."""
    sf = "/root/testdata/sf0.1"
    out = Q.op9(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = {r["quality"]: (r["n"], r["lost"]) for r in out.filter("not base_failed").join(labels, "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), F.sum((~F.col("kept")).cast("int")).alias("lost")).collect()}
    assert seen[0][1] > seen[0][0] / 2
    assert seen[1][1] <= 0.03 * seen[1][0]


def test_fixed_sequence_is_the_lowest_cutoff_under_the_level(spark):
    rows = [("en", 100, i % 20 // 10 * 3, 1, 0, 0, 50) for i in range(3000)]
    good = spark.createDataFrame(rows, "stratum string, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_words long")
    got = {r["rule"]: r["cutoff"] for r in rules.cutoffs(good).collect()}
    assert got == {"symbols": 30, "dup_lines": 10, "repeats": 10}  # 10 and 20 thousandths would reject half


def test_archives_are_read_back_on_as_many_tasks_as_bundles(spark):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("http://a/b").alias("url"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("html"))
    index = warc.write(pages.repartition(6), warc.archive_folder(spark))
    bundles = index.select("bundle").distinct().count()
    assert bundles > 1
    back = warc.read(spark, index)
    assert back.rdd.getNumPartitions() == bundles
    assert sorted(r["page_id"] for r in back.collect()) == list(range(60))


def test_codec_is_not_pickled_by_reference():
    """A worker without this package on its path can run the codec."""
    code = """
import sys; sys.path.insert(0, %r)
from pyspark import cloudpickle
import cohortile
from cohortile.llm import pieces
open(sys.argv[1], 'wb').write(cloudpickle.dumps(lambda: pieces.codec(pieces.MODEL, ()).decode(pieces.codec(pieces.MODEL, ()).encode('some text'))))
""" % os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import tempfile
    if not os.path.exists(corpus_pipeline.pieces.MODEL):
        pytest.skip("no model")
    with tempfile.TemporaryDirectory() as d:
        subprocess.run([sys.executable, "-c", code, f"{d}/f"], cwd=d, check=True, timeout=120)
        said = subprocess.run([sys.executable, "-c", "import pickle,sys; print(pickle.load(open(sys.argv[1],'rb'))())", f"{d}/f"], cwd=d, capture_output=True, text=True, timeout=120,
                              env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.stdout.strip() == "some text", said.stderr
