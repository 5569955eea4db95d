import pytest
from pyspark.sql import functions as F

from trialgrid.session import checkpoint_dir
from trialgrid.sources import readers as RD
from trialgrid.sources import sinks as SK
from trialgrid.streaming import runlog


def test_landscape_csv_is_checked_and_deduplicated(spark, tmp_path):
    good = "round,seed,hits,positional_mae\n1,42,4,1.0\n1,42,5,0.5\n1,99,4,2.0\n"
    (tmp_path / "a.csv").write_text(good)
    assert RD.read_landscape(spark, [str(tmp_path / "a.csv")]).count() == 2
    (tmp_path / "b.csv").write_text(good + "1,7,3,1.0\n")
    with pytest.raises(ValueError):
        RD.read_landscape(spark, [str(tmp_path / "b.csv")])


def test_draw_headers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Round,Num 1,num_2,N3,n4,number5,n6,Bonus\n7,9,8,7,6,5,4,1\n,1,2,3,4,5,6,7\n")
    assert [tuple(r) for r in RD.read_draws(spark, str(tmp_path / "d.csv")).collect()] == [(7, [4, 5, 6, 7, 8, 9], 1)]
    with pytest.raises(ValueError):
        RD.aliased_draws(spark.createDataFrame([(1,)], "other int"))


def test_run_log_version_and_tables(spark, tmp_path):
    line = '{"schema_version":"%s","run_id":"r1","problem":{"problem_id":1,"problem_seed":5,"problem_family":"f"},"result":{"quality":0.5,"runtime":1.0},"traces":[{"step":1,"fraction":1.0,"objective":2.0}]}\n'
    (tmp_path / "ok.jsonl").write_text(line % RD.RUN_LOG_VERSION + "\n")
    t = RD.log_tables(RD.read_run_log(spark, str(tmp_path / "ok.jsonl")))
    assert t["traces"].count() == 1 and "problem_seed" not in t["problem_features"].columns
    (tmp_path / "bad.jsonl").write_text(line % "other")
    with pytest.raises(Exception, match="unsupported run log version"):
        RD.read_run_log(spark, str(tmp_path / "bad.jsonl")).collect()


def test_sinks_reconcile(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"b": 1, "a": 2})], "k int, a array<int>, m map<string,int>")
    r = SK.nested_as_json(df).first()
    assert (r["a"], r["m"]) == ("[1,2]", '{"a":2,"b":1}')
    SK.write_dataset({"t": df}, str(tmp_path / "ds"), {"t": ["k"]}, {"t": 1})
    with pytest.raises(ValueError):
        SK.write_dataset({"t": df}, str(tmp_path / "ds2"), {}, {"t": 2})
    assert SK.expected_search_rows(192, 1_000_000, 100, 100_000, 3) == {"rounds": 192, "top_k": 19200, "buckets": 1920, "curve": 576}


def test_stream_takes_each_run_once_across_restarts(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write = lambda rows: spark.createDataFrame(rows, "run_id int, s string").withColumn("ts", F.to_timestamp("s")).drop("s").coalesce(1).write.mode("append").parquet(src)
    go = lambda: runlog.ingest(spark.readStream.schema("run_id int, ts timestamp").parquet(src), "run_id", "ts", out, state)
    write([(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-01")])
    go()
    # a repeated old id, a new id with an old time, an id seen long ago
    write([(2, "2024-01-03"), (3, "2023-01-03"), (1, "2026-01-01")])
    go()
    write([(5, "2020-01-01"), (1, "2030-01-01")])
    go()
    got = sorted((r["run_id"], str(r["ts"])[:10]) for r in runlog.read_log(spark, out).collect())
    assert got == [(1, "2024-01-01"), (2, "2024-01-01"), (3, "2023-01-03"), (5, "2020-01-01")]


def test_unknown_run_is_an_error(spark):
    rec, plan = spark.createDataFrame([(1,), (9,)], "run_id int"), spark.createDataFrame([(1,)], "run_id int")
    with pytest.raises(Exception, match="unknown run"):
        runlog.known_only(rec, plan, "run_id").collect()


def test_checkpoint_folder_is_set(spark):
    assert checkpoint_dir(spark)
