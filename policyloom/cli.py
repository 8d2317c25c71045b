"""Command line: python -m policyloom.cli JOB ... Exit codes: 0 done, 1 refused, 2 usage."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="policyloom")
    jobs = top.add_subparsers(dest="job", required=True)
    sft = jobs.add_parser("sft", help="training rows in three splits")
    sft.add_argument("--track", choices=("track_a", "track_b"), required=True)
    sft.add_argument("--cases")
    sft.add_argument("--evidence")
    rl = jobs.add_parser("rl", help="prompt-only rows in three splits")
    rl.add_argument("--mode", choices=("grpo", "opsd"), required=True)
    for sub in (sft, rl):
        sub.add_argument("--tasks", required=True)
        sub.add_argument("--oracles", required=True)
        sub.add_argument("--out", required=True)
        sub.add_argument("--seed", type=int, default=42)
        sub.add_argument("--ratios", type=float, nargs=3, default=(0.8, 0.1, 0.1), metavar=("TRAIN", "DEV", "HOLDOUT"))
    imports = jobs.add_parser("import", help="public cases of a configuration")
    imports.add_argument("--config", required=True)
    imports.add_argument("--out", required=True)
    manifest = jobs.add_parser("manifest", help="check a crawl manifest")
    manifest.add_argument("--path", required=True)
    plan = jobs.add_parser("plan", help="a release's blueprints, without asking a provider")
    plan.add_argument("--policies", required=True)
    plan.add_argument("--seeds", required=True)
    plan.add_argument("--count", type=int, choices=(100, 500, 2000), required=True)
    plan.add_argument("--seed", default="release")
    plan.add_argument("--out", required=True)
    return top


def run(spark, args: argparse.Namespace) -> dict:
    """One job; returns what it reports."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from . import jobs
    from .operators import planning, records
    from .sources import readers, writers

    if args.job == "sft":
        return jobs.sft_bundle(spark, args.track, args.tasks, args.oracles, args.out, args.cases, args.evidence, args.seed, tuple(args.ratios))
    if args.job == "rl":
        return jobs.rl_bundle(spark, args.mode, args.tasks, args.oracles, args.out, args.seed, tuple(args.ratios))
    if args.job == "import":
        return jobs.import_cases(spark, args.config, jobs.distinct_path(args.out, args.config)).first().asDict()
    if args.job == "manifest":
        return {"sources": jobs.load_manifest(spark, args.path).count()}
    policies = readers.read_jsonl(spark, args.policies, f"policy_id string, rules {jobs.RULES}", "policy_id")
    # A release has a handful of policies.
    policies = policies.withColumn("position", F.row_number().over(Window.orderBy("policy_id")) - 1)
    if not records.policy_violations(policies).isEmpty():
        raise ValueError("a policy breaks a rule")
    seeds = readers.read_jsonl(spark, args.seeds, "source string, source_id string, content_hash string, text string", strict=False)
    plan = planning.plan_blueprints(spark, policies, seeds, args.count, args.seed)
    writers.write_jsonl(plan, jobs.distinct_path(args.out, args.policies, args.seeds))
    return {"planned": spark.read.json(args.out).count()}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("policyloom").getOrCreate()
    try:
        report = run(spark, args)
    except ValueError as error:
        print(str(error), file=sys.stderr)
        return 1
    print(json.dumps(report, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
