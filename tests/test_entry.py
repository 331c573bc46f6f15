import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pathloom import config as C
from pathloom.operators import telemetry
from pathloom.plans import cli, functions
from pathloom.plans.registry import ORACLE_SQL, QUERIES
from pathloom.sources.store import Store

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels".split()


def plain(df):
    def cell(v):
        return None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) else v

    cols = sorted(df.columns)
    return sorted((tuple(cell(r[c]) for c in cols) for r in df.to_dict("records")), key=repr)


@pytest.mark.parametrize("name", ["seq_ngram_support", "seq_exact_topk", "traj_clean_rules", "traj_gap_segments", "suffix_repeats", "transition_edges", "pattern_containment", "grid_entropy"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_telemetry(spark, tmp_path):
    path = f"file://{tmp_path}/t.jsonl"
    with pytest.raises(ValueError), telemetry.stage(spark, "a", "sample", path) as r:
        r["n"] = 3
        raise ValueError
    got = json.loads(Store(spark, f"file://{tmp_path}")["t.jsonl"])
    assert got["ok"] is False and got["n"] == 3 and got["wall_s"] >= 0
    assert telemetry.environment(spark).filter(~F.col("ok")).count() == 0


def test_table_functions(spark):
    functions.register(spark)
    w = spark.sql("SELECT * FROM seq_windows(array('a', 'b', 'a', 'b'), 2, 3)").collect()
    assert {(r["key"], r["n"]) for r in w} == {("a>b", 2), ("b>a", 2), ("a>b>a", 3), ("b>a>b", 3)}
    assert spark.sql("SELECT * FROM seq_suffixes(array('a', 'b', 'c', 'd'), 3, 200)").count() == 2
    assert [r[0] for r in spark.sql("SELECT * FROM match_patterns(array('a', 'b'), array('b>a', 'a>b'))").collect()] == [1]


def test_command_line(capsys, tmp_path):
    assert cli.main(["--data", SF, "--out", str(tmp_path), "--mid", "--dry-run", "traj_cells"]) == 0
    assert capsys.readouterr().out.split() == [f"{SF}/clean_mid", "traj_cells"]
    with pytest.raises(SystemExit):
        cli.main(["--data", SF, "--out", "x", "nope"])


def test_stages_of_a_whole_run(spark, tmp_path):
    """Raw trips through every stage, with the command line's switches."""
    from pathloom.plans import stages
    from pathloom.sources import derived as D
    from pathloom.sources import trips as T

    data, out = f"file://{tmp_path}/data", f"file://{tmp_path}/out"
    T.write_raw(D.raw_trips(spark, SF), f"{data}/raw_sample")
    T.write_raw(D.raw_trips(spark, SF).filter("TRIP_ID like '%1'"), f"{data}/held")
    timings = tmp_path / "t.jsonl"
    timings.write_text("".join(json.dumps({"run_id": r, "workers": w, "stage": "a", "wall_s": s, "ok": True}) + "\n" for r, w, s in (("x", 2, 10.0), ("y", 4, 6.0))))
    a = ["--data", data, "--out", out, "--sample", "--x-pct", "4", "--compare-grids", "--floor-pct", "5", "--caps", "20", "60", "--min-len-km", "1", "--held-out", f"{data}/held", "--timings", str(timings)]
    o = cli.parser().parse_args([*a, "--stage", "all"])
    paths = C.data_paths(data, "sample")
    got = {}
    for name, f in stages.STAGES.items():
        results = f(spark, paths, o)
        stages.write(spark, results, out)
        got |= {k: spark.read.parquet(k if "/" in k else f"{out}/{k}") for k in results}
    assert got[paths.clean].count() == got[paths.features].count() == 73 and got["leaks"].first()["leaked"] == 0
    assert got["drops"].first()["encoded"] == got[paths.encoded].count() > 0
    assert {r["workers"] for r in got["scaling"].collect()} == {2, 4} and got["holdout"].first()["own"] > 0
    for name in ("suffix_top", "exact_top", "maximal_top", "approx_top", "zones", "temporal", "cap_experiment", "grids", "suffix_floors"):
        assert got[name].count() > 0, name
    o.baseline, o.no_calibrate, o.approx_only = out, True, True
    assert all(r["ok"] for r in stages.verify(spark, paths, o)["tiers"].collect())
    assert set(stages.suffixes(spark, paths, o)) == {"suffix_top", "suffix_holes"} and set(stages.sketches(spark, paths, o)) == {"approx_top"}
    assert cli.main([*a, "--stage", "clean", "--dry-run"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["--data", data, "--out", out, "--stage", "holdout"])
