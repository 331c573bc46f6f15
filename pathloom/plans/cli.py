"""Command line.

python -m pathloom.plans.cli --data DIR --out DIR [--format parquet|csv|json] [--dry-run] [QUERY ...]
    runs registered queries over a folder of tables and writes their results;
python -m pathloom.plans.cli --data DIR --out DIR --stage NAME [--stage NAME ...] [options of stages]
    runs stages over the raw trips of a scale: see pathloom.plans.stages.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from pathloom import config as C
from pathloom.operators.telemetry import counted, stage
from pathloom.plans.registry import QUERIES
from pathloom.plans.stages import STAGES, write


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    scale = p.add_mutually_exclusive_group()
    for s in ("sample", "mid", "full"):
        scale.add_argument(f"--{s}", dest="scale", action="store_const", const=s)
    scale.add_argument("--scale", choices=sorted(C.SCALES))
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"))
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--stage", action="append", choices=[*STAGES, "all"], help="a stage, in place of queries")
    p.add_argument("--max-trips", type=int, help="clean: a sample of that size; exact: the most it takes")
    p.add_argument("--approx-only", action="store_true", help="sketches: no exact recount")
    p.add_argument("--x-pct", type=float, default=C.SUPPORT_X_PCT, help="maximal, suffixes: the floor, as a share of trips")
    p.add_argument("--no-calibrate", action="store_true", help="maximal, suffixes: that floor only")
    p.add_argument("--compare-grids", action="store_true", help="encode: other grids too")
    p.add_argument("--floor-pct", type=float, default=0.05, help="temporal: the floor, as a share of a bucket's trips")
    p.add_argument("--min-len-km", type=float, default=3.0, help="holdout: routes from that length on")
    p.add_argument("--held-out", help="holdout: raw trips of the other source")
    p.add_argument("--caps", type=int, nargs="+", default=[5_000, 10_000, 25_000, 50_000], help="caps: sample sizes")
    p.add_argument("--timings", help="runs: JSON lines of stage timings")
    p.add_argument("--baseline", help="verify: another run's results")
    p.add_argument("--build-sample", help="writes a CSV sample of the raw trips there first")
    p.add_argument("queries", nargs="*")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    a.scale = a.scale or "sample"
    paths = C.data_paths(a.data, a.scale)
    needs = {"holdout": a.held_out, "runs": a.timings}
    stages = a.stage or []
    if "all" in stages:  # those whose extra input is named
        stages = [s for s in STAGES if needs.get(s, True)]
    if missing := [s for s in stages if s in needs and not needs[s]]:
        raise SystemExit(f"input missing for: {', '.join(missing)}")
    names = [] if stages else a.queries or list(QUERIES)
    if unknown := [n for n in names if n not in QUERIES]:
        raise SystemExit(f"unknown: {', '.join(unknown)}")
    if a.dry_run:
        print("\n".join([paths.clean, *stages, *names]))
        return 0
    spark = SparkSession.builder.appName("pathloom").config("spark.sql.session.timeZone", C.TIME_ZONE).getOrCreate()
    if a.build_sample:
        from pathloom.sources.trips import read_raw, write_sample_csv

        write_sample_csv(read_raw(spark, paths.raw), a.build_sample, C.SCALES[a.scale] or C.SCALES["sample"])
    log = C.join_path(a.out, "timings.jsonl")
    for n in stages:
        with stage(spark, n, a.scale, log):
            write(spark, STAGES[n](spark, paths, a), a.out)
    for n in names:
        with stage(spark, n, a.scale, log) as record:
            df, o = counted(QUERIES[n](spark, a.data))
            df.write.mode("overwrite").format(a.format).save(C.join_path(a.out, n))
            record |= o.get
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
