"""Command line for the pipeline jobs.

python -m stridelake.cli land   --source RAW --landing LANDING --quarantine Q [--start D --end D]
python -m stridelake.cli backfill --source RAW --landing LANDING --quarantine Q --start D --end D
python -m stridelake.cli build  --landing LANDING --out MODELS [--lookback N] [--full-refresh] [--all-landings]
python -m stridelake.cli quality (--models MODELS | --landing LANDING)
python -m stridelake.cli stream --source LANDING/asset --target BRONZE/asset --keys k1,k2 --checkpoint C

The session comes from ``spark-submit`` (its settings win); paths may be any
Hadoop filesystem URI.
"""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="stridelake")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("land", "backfill"):
        p = sub.add_parser(name)
        p.add_argument("--source", required=True)
        p.add_argument("--landing", required=True)
        p.add_argument("--quarantine", required=True)
        p.add_argument("--start", required=name == "backfill")
        p.add_argument("--end", required=name == "backfill")
        p.add_argument("--assets", help="comma-separated; default: all enabled")
        p.add_argument("--no-gate", action="store_true")
        p.add_argument("--on-malformed", choices=["raise", "quarantine"], default="raise")
    p = sub.add_parser("build")
    p.add_argument("--landing", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--lookback", type=int, default=0)
    p.add_argument("--full-refresh", action="store_true")
    p.add_argument("--all-landings", action="store_true", help="keep every landing of a key inside one load")
    p = sub.add_parser("quality")
    where = p.add_mutually_exclusive_group(required=True)
    where.add_argument("--models", help="the tables that build wrote")
    where.add_argument("--landing", help="models recomputed from the landing tables")
    p = sub.add_parser("stream")
    p.add_argument("--source", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--keys", required=True)
    p.add_argument("--partition", default="dt")
    p.add_argument("--checkpoint", required=True, help="folder that records which files were read")
    args = ap.parse_args(argv)

    from .session import get_spark

    spark = get_spark()
    if args.cmd in ("land", "backfill"):
        from .config import default_config
        from .plans.landing import run_backfill, run_landing

        cfg = default_config(source_path=args.source, landing_path=args.landing, quarantine_dir=args.quarantine)
        assets = args.assets.split(",") if args.assets else None
        job = run_backfill if args.cmd == "backfill" else run_landing
        summary = job(
            spark, cfg, args.start, args.end, assets, gate=not args.no_gate, on_malformed=args.on_malformed
        )
        print(json.dumps({k: v for k, v in summary.items() if k != "per_asset"}))
    elif args.cmd == "build":
        from .plans.medallion import build_all

        paths = build_all(spark, args.landing, args.out, args.lookback, args.full_refresh, not args.all_landings)
        print(json.dumps(paths))
    elif args.cmd == "quality":
        from .plans.medallion import bronze_tables, models_from_landing, quality_report, stored_quality_report

        if args.models:
            report = stored_quality_report(spark, args.models)
        else:
            report = quality_report(models_from_landing(spark, args.landing), bronze_tables(spark, args.landing))
        failed = [r.asDict() for r in report.filter("failures > 0").collect()]  # one row per failing test
        print(json.dumps({"failed_tests": failed}))
        return 1 if failed else 0
    elif args.cmd == "stream":
        from .streaming.landing_stream import stream_upsert

        stream_upsert(spark, args.source, args.target, args.keys.split(","), args.partition, args.checkpoint)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
