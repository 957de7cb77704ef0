import json
import os

import pytest
from pyspark.sql import functions as F

from cohortile.session import durable, require_columns
from cohortile.sources import readers as I
from cohortile.sources import writers as W

XML = """<Annotations><Annotation LineColor="65280"><Regions>
<Region><Vertices><Vertex X="0" Y="0"/><Vertex X="4.5" Y="0"/><Vertex X="0" Y="4"/></Vertices></Region>
<Region><Vertices><Vertex X="0" Y="0"/><Vertex X="1" Y="1"/></Vertices></Region></Regions></Annotation>
<Annotation LineColor="65535"><Regions><Region><Vertices><Vertex X="0" Y="0"/><Vertex X="9" Y="0"/><Vertex X="0" Y="9"/><Vertex X="3"/></Vertices></Region></Regions></Annotation>
<Annotation LineColor="255"><Regions><Region><Vertices><Vertex X="0" Y="0"/><Vertex X="9" Y="0"/><Vertex X="0" Y="9"/></Vertices></Region></Regions></Annotation></Annotations>"""


def test_annotations(spark, tmp_path):
    docs = spark.createDataFrame([("s1", XML)], "slide_id string, content string")
    by = lambda d: sorted((r.tissue, len(r.verts)) for r in I.parse_annotations(docs, dialect=d).collect())
    assert by("color") == [("benign", 3), ("tumor", 3)]
    assert by("union") == [("tumor", 3), ("tumor", 3)]
    with pytest.raises(Exception, match="vertex without X or Y"):
        by("all")
    (tmp_path / "s1.tumor.xml").write_text(XML)
    got = I.read_polygons(spark, str(tmp_path / "*.xml"), "color").collect()
    assert sorted((r.slide_id, r.tissue, r.verts[1].x) for r in got) == [("s1", "benign", 9.0), ("s1", "tumor", 4.5)]


def test_annotation_rules(spark):
    f = spark.createDataFrame([(p,) for p in ["/a/s1_x_tumor_2.xml", "/a/s1_a_tumor.xml", "/a/s2.normal.xml", "/a/s3.xml", "/a/s4/s4.tumor.xml", "/a/s4/s4.TUM.xml"]], "path string")
    s = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "slide_id string")
    find = lambda t: {(r.slide_id, r.tissue): r.path.split("/")[-1] for r in I.annotation_candidates(f, s, t).collect()}
    assert find("prostate") == {("s3", "tumor"): "s3.xml"}
    assert find("rectal") == {("s4", "tumor"): "s4.tumor.xml"} and find("rectal_classes") == {("s4", "TUM"): "s4.TUM.xml"}
    k = find("kidney")
    assert k[("s1", "tumor")] == "s1_a_tumor.xml" and k[("s2", "normal")] == "s2.normal.xml"


def test_splits_and_params(spark, tmp_path):
    (tmp_path / "f.csv").write_text("train,val,test\na,b,c\nd,,\n")
    got = {(r.fold, r.slide_id, r.split) for r in I.read_splits(spark, str(tmp_path / "f.csv"), 3).collect()}
    assert got == {(3, "a", "train"), (3, "d", "train"), (3, "b", "val"), (3, "c", "test")}
    long = spark.createDataFrame([("a", 1), ("b", 3), ("c", 9)], "slide_id string, split int")
    assert {(r.slide_id, r.split) for r in I.long_splits(long).collect()} == {("a", "train"), ("b", "test")}
    pl = spark.createDataFrame([("s1", 1, "5", ""), ("s2", 0, "1", "q"), ("s3", 1, None, "z")], "slide_id string, process int, a_t string, fn string")
    assert {r.slide_id: (r.a_t, r.fn, r.extra) for r in I.per_slide_params(pl, {"a_t": 7, "fn": "four_pt", "extra": 1.5}).collect()} == {
        "s1": (5, "four_pt", 1.5), "s3": (7, "z", 1.5)}
    reg = I.model_registry(spark, "u,v", "/d", "/x,/y", {"u": 1536}).collect()
    assert [(r.model, r.data_dir, r.stability_dir, r.dim) for r in reg] == [("u", "/d", "/x", 1536), ("v", "/d", "/y", 1024)]
    with pytest.raises(ValueError):
        I.model_registry(spark, "u,v,w", "/a,/b")


def test_columns_and_dims(spark, tmp_path):
    a = spark.createDataFrame([("s", [1.0, 2.0], 0.5)], "slide_id string, coords array<double>, attn double")
    r = I.normalize_attention_columns(a).first()
    assert (r.score, r.x, r.y) == (0.5, 1.0, 2.0)
    with pytest.raises(ValueError):
        I.normalize_attention_columns(a.drop("attn"))
    with pytest.raises(ValueError):
        require_columns(a, ["nope"])
    (tmp_path / "c.csv").write_text("PatientID,tumor_grade,more\np1,G1,x\n")
    assert I.read_clinical(spark, str(tmp_path / "c.csv"), ["PatientID", "tumor_grade"]).columns == ["PatientID", "tumor_grade"]
    v = spark.createDataFrame([("m", "a", 1, 1, [1.0, 2.0]), ("m", "b", 1, 1, [1.0, 2.0]), ("m", "c", 1, 1, [1.0]), ("m", "d", 1, 1, []), ("m", "e", 1, 1, None), ("m", "e", 1, 2, [3.0, 4.0])],
                              "model string, slide_id string, x int, y int, features array<double>")
    v.write.parquet(str(tmp_path / "t"))
    ok = I.read_tiles(spark, str(tmp_path / "t"), "m")
    assert sorted(r.slide_id for r in ok.collect()) == ["a", "b", "c"]
    good, bad = I.split_by_dim(ok)
    assert good.count() == 2 and bad.first().reason == "length 1, expected 2"
    p = spark.createDataFrame([("/x/20x_512px/features_uni",), ("/x/plain/",)], "path string")
    assert [(r.magnification, r.tile_px, r.embedding_name) for r in I.path_metadata(p, "path").collect()] == [(20, 512, "uni"), (20, 256, "plain")]
    with pytest.raises(Exception, match="no magnification"):
        I.path_metadata(p, "path", strict=True).collect()


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1, 1), ("b", 0.2, 2)], "model string, threshold double, n int")
    W.write_partitioned(df, str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).filter("model = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan
    W.write_report({"summary": df, "tests": df.limit(1)}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/summary")).count() == 2
    W.write_small_csv(df, str(tmp_path / "c"))
    ids = spark.createDataFrame([("a",), ("z",)], "slide_id string")
    have = spark.createDataFrame([("a",)], "slide_id string")
    W.write_run_metadata(ids, have, {"k": 5}, str(tmp_path / "m"))
    meta = json.loads(next((tmp_path / "m/metadata").glob("*.json")).read_text())
    assert meta == {"n_wanted": 2, "n_present": 1, "n_missing": 1, "k": 5}
    assert "".join(f.read_text() for f in (tmp_path / "m/missing").glob("*.txt")).split() == ["z"]
    calls = []

    def compute(todo):
        calls.append(sorted(r.slide_id for r in todo.collect()))
        return todo.withColumn("v", F.lit(1))

    W.resume(spark, have, str(tmp_path / "w"), ["slide_id"], compute)
    out = W.resume(spark, ids, str(tmp_path / "w"), ["slide_id"], compute)
    assert calls == [["a"], ["z"]] and out.count() == 2


def test_shared_folder_is_the_sessions(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert durable(spark.range(5)).count() == 5
    assert [n for n in set(os.listdir(folder)) - before if n.startswith("step-")]
