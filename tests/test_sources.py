"""Readers and writers on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from stridewell.sources import readers as R


def rows(df):
    return sorted(tuple(r) for r in df.select("user", F.col("ts").cast("string"), "item", "cat", "lat", "lon", "name").collect())


def test_tab8(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes(b"1\tv\tid\tBar\t40.5\t-74.0\t-240\tTue Apr 03 18:00:09 +0000 2012\n1\tshort\n2\tw\tid\tCaf\xe9\t1\t2\t0\tnot a time\n3\tx\tid\tGym\t1\t2\t60\tTue Apr 03 18:00:09 +0200 2012\n")
    assert rows(R.resolve(spark, "tab8", str(tmp_path / "a.tsv"))) == [("1", "2012-04-03 18:00:09", "v", "Bar", 40.5, -74.0, None), ("3", "2012-04-03 16:00:09", "x", "Gym", 1.0, 2.0, None)]


def test_tab5_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("0\t2010-10-19T23:55:27Z\t30.2\t-97.7\t22847\n0\tbad\t1\t1\t5\n1\t2010-10-18T22:17:43Z\t\t\t420315\n1\t2010\n")
    assert rows(R.read_tab5(spark, str(tmp_path / "b.txt.gz"))) == [("0", "2010-10-19 23:55:27", "22847", None, 30.2, -97.7, None), ("1", "2010-10-18 22:17:43", "420315", None, None, None, None)]


def test_steps_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('user_id,venue_id,latitude,longitude,name,venue_category,timestamp\nu1,v1,40.1,-73.9,"Joe, Inc",Bar,2012-04-03 18:00:09+extra\nu2,v2,,,,Park,2017-01-01 00:00:00\nu3,v3,1,1,n,c,never\n')
    assert rows(R.read_steps_csv(spark, str(tmp_path / "c.csv"))) == [("u1", "2012-04-03 18:00:09", "v1", "Bar", 40.1, -73.9, "Joe, Inc"), ("u2", "2017-01-01 00:00:00", "v2", "Park", None, None, None)]


def test_grid_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text("uid,d,t,x,y\n7,1,3,10,20\n")
    assert rows(R.read_grid_csv(spark, str(tmp_path / "d.csv"))) == [("7", "2000-01-02 01:30:00", "10_20", None, None, None, None)]


def test_resolve_fails_early(spark, tmp_path):
    with pytest.raises(KeyError):
        R.resolve(spark, "nope", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        R.resolve(spark, "tab5", str(tmp_path / "missing"))


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("x", "u2", 5, 1, "p\nq", [1.0, None]), ("x", "u1", 5, 0, "ü", None)], R.QUESTION)
    R.write_jsonl(df, str(tmp_path / "q"), ["user"], one_file=True)
    with pytest.raises(Exception, match="(?i)exists"):
        R.write_jsonl(df, str(tmp_path / "q"), ["user"])
    back = R.read_jsonl(spark, str(tmp_path / "q"), R.QUESTION).collect()
    assert [r.user for r in back] == ["u1", "u2"] and back[1].cand_km == [1.0, None] and back[1].prompt == "p\nq"
    (tmp_path / "bad.jsonl").write_text('{"row": 1}\n\n{"row": \n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, str(tmp_path / "bad.jsonl"), R.PREDICTION).collect()


def test_object_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"scores": {"a": 0.5, "b": 1}}')
    (tmp_path / "n.json").write_text('{"a": 0.25}')
    assert sorted(map(tuple, R.read_object_map(spark, str(tmp_path / "m.json")).collect())) == [("a", 0.5), ("b", 1.0)]
    assert R.read_object_map(spark, str(tmp_path / "n.json")).first().score == 0.25
    with pytest.raises(ValueError):
        R.read_object_map(spark, str(tmp_path / "n.json"), 2)


def test_score_folders(spark, tmp_path):
    for p in ("armA/s0/scores_dev.jsonl", "armB/world1/s3/scores_x_test.jsonl"):
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True)
        f.write_text('{"user": "u", "answer_idx": 1, "scores": [0.1, 0.9]}\n')
    got = sorted((r.arm, r.world, r.seed, r.split) for r in R.read_score_folders(spark, str(tmp_path / "root")).collect())
    assert got == [("armA", None, 0, "dev"), ("armB", "world1", 3, "test")]
    (tmp_path / "summary.json").write_text('{"files": {"dev": {"Hit@1": {"mean": 0.375}}}}')
    assert R.read_summary(spark, str(tmp_path / "summary.json"), "dev").first().mean == 0.375


def test_outlines(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    fc = {"type": "FeatureCollection", "features": [{"properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(fc))
    got = sorted((r.name, r.ring, len(r.points)) for r in R.read_outlines(spark, str(tmp_path / "g.json")).collect())
    assert got == [("m", 0, 4), ("m", 1, 4), ("p", 0, 4)]


def test_metric_and_log_lines(spark):
    page = ['# HELP x', 'requests_total{endpoint="/pick",status="200"} 12', 'seconds_bucket{endpoint="/pick",le="+Inf"} 3.5e1', "up 1", "bad line here {", "size +Inf"]
    got = {(r.metric, tuple(sorted(r.labels.items()))): r.value for r in R.read_metric_lines(spark.createDataFrame([(x,) for x in page], "value string")).collect()}
    assert got[("requests_total", (("endpoint", "/pick"), ("status", "200")))] == 12.0
    assert got[("seconds_bucket", (("endpoint", "/pick"), ("le", "+Inf")))] == 35.0
    assert got[("up", ())] == 1.0 and got[("size", ())] == float("inf") and len(got) == 4
    logs = spark.createDataFrame([('{"rid":"a","status":200}',), ("plain",), ('{"x":1}',)], "value string")
    assert [r.rid for r in R.read_log_lines(logs).collect()] == ["a"]


def test_reports(spark, tmp_path):
    R.write_report(spark.createDataFrame([(1, "ü")], "a int, b string"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"a": 1, "b": "ü"}
    with pytest.raises(ValueError):
        R.write_report(spark.range(2), str(tmp_path / "s.json"))
    assert R.markdown_table(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_registry_limit_and_json_arguments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("uid,d,t,x,y\n" + "\n".join(f"{k},1,2,3,{k}" for k in range(9)))
    registry = {"small": ("grid_csv", "a.csv")}
    assert R.resolve_named(spark, registry, "small", str(tmp_path)).count() == 9
    assert [r.user for r in R.resolve_named(spark, registry, "small", str(tmp_path), limit=3).collect()] == ["0", "1", "2"]
    with pytest.raises(KeyError, match="small"):
        R.resolve_named(spark, registry, "large", str(tmp_path))
    with pytest.raises(ValueError):
        R.limited(spark.range(3), -1, "id")
    assert R.checked_json('{"a": 1}', dict, {"a", "b"}) == {"a": 1} and R.checked_json("[1]", list) == [1]
    with pytest.raises(TypeError, match="expected list"):
        R.checked_json("{}", list)
    with pytest.raises(ValueError, match="unknown keys: c"):
        R.checked_json('{"c": 1}', dict, {"a"})
