"""Command line of the batch steps and reads.

    python -m mendlist ingest --store /store --csv reviews.csv
    python -m mendlist flow --store /store --csv reviews.csv --category pkg.mod:load_a --sentiment pkg.mod:load_b
"""

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from mendlist import fixed
from mendlist.operators import backlog as B
from mendlist.operators.aspects import scorer
from mendlist.operators.taxonomy import list_features
from mendlist.plans import baseline, flow
from mendlist.plans.ingest import Tables, ingest_csv, seed_features
from mendlist.plans.preprocess import preprocess
from mendlist.sources.readers import read_reviews_csv


def named_model(name: str):
    """A scorer from ``package.module:function``."""
    module, function = name.split(":")
    return scorer(getattr(importlib.import_module(module), function))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mendlist")
    steps = top.add_subparsers(dest="step", required=True)

    def step(name, help_text, store=True):
        sub = steps.add_parser(name, help=help_text)
        if store:
            sub.add_argument("--store", required=True, help="root folder of the tables")
        return sub

    def models(sub):
        sub.add_argument("--category", help="package.module:function of the category model")
        sub.add_argument("--sentiment", help="package.module:function of the sentiment model")

    sub = step("ingest", "load an annotated CSV")
    sub.add_argument("--csv", required=True)
    sub.add_argument("--one-line", action="store_true", help="no cell holds a line break: split large files")
    step("seed", "store the feature taxonomy")
    sub = step("preprocess", "clean, deduplicate, split, write training records")
    sub.add_argument("--test", type=float, default=fixed.TEST_SHARE)
    sub.add_argument("--val", type=float, default=fixed.VAL_SHARE)
    sub.add_argument("--seed", type=int, default=fixed.SPLIT_SEED)
    sub = step("train", "fit the baseline models")
    sub.add_argument("--models", required=True, help="folder to save them in")
    sub.add_argument("--limit", type=int)
    sub = step("infer", "find aspects and store them")
    models(sub)
    sub.add_argument("--models", help="folder of baseline models, instead of named ones")
    sub.add_argument("--split", default="test")
    sub.add_argument("--limit", type=int)
    sub.add_argument("--run", help="name of the run; the split unless given")
    step("score", "recompute criticality").add_argument("--half-life", type=int, default=fixed.HALF_LIFE_DAYS)
    sub = step("flow", "all steps in turn")
    models(sub)
    sub.add_argument("--csv")
    sub.add_argument("--split", default="test")
    sub.add_argument("--limit", type=int)
    sub.add_argument("--half-life", type=int, default=fixed.HALF_LIFE_DAYS)
    sub = step("backlog", "ranked features")
    sub.add_argument("--priority", choices=["high", "low"])
    sub.add_argument("--limit", type=int, default=fixed.PAGE_DEFAULT)
    step("trend", "windowed scores of one feature").add_argument("--feature", required=True)
    step("features", "the taxonomy").add_argument("--all", action="store_true")
    sub = step("analyse", "keyword analysis of a CSV with a review column", store=False)
    sub.add_argument("--csv", required=True)
    return top


def run(spark: SparkSession, args) -> None:
    say = lambda value: print(json.dumps(value, default=str))
    if args.step == "analyse":
        out = flow.analyse(read_reviews_csv(spark, args.csv))
        out["priorities"].show(truncate=False)
        print(out["summary"].first()["summary_text"])
        return
    tables = Tables(args.store)
    if args.step == "ingest":
        ingest_csv(spark, args.csv, tables, not args.one_line)
        say({"reviews": tables.reviews(spark).count()})
    elif args.step == "seed":
        seed_features(spark, tables)
        say({"features": tables.features(spark).count()})
    elif args.step == "preprocess":
        say(preprocess(spark, tables, test=args.test, val=args.val, seed=args.seed))
    elif args.step == "train":
        models, report = baseline.train(spark, tables, limit=args.limit)
        baseline.save(models, args.models)
        say({f"{r.task}.{r.metric}": r.value for r in report.collect()})  # some forty rows
    elif args.step == "infer":
        if args.models:
            say(flow.infer_with_models(spark, tables, baseline.load(spark, args.models), args.split, args.limit, args.run))
        else:
            scorers = named_model(args.category), named_model(args.sentiment)
            say(flow.infer(spark, tables, *scorers, args.split, args.limit, args.run))
    elif args.step == "score":
        say({"scores": flow.score(spark, tables, args.half_life)})
    elif args.step == "flow":
        scorers = named_model(args.category), named_model(args.sentiment)
        say(flow.run(spark, tables.root, *scorers, args.csv, args.split, args.limit, args.half_life))
    elif args.step == "backlog":
        B.backlog(tables.scores(spark), tables.features(spark), args.priority, args.limit).show(args.limit, False)
    elif args.step == "trend":
        B.trend_points(tables.scores(spark), tables.features(spark), args.feature).show(fixed.PAGE_MAX, False)
    elif args.step == "features":
        list_features(tables.features(spark), not args.all).show(fixed.PAGE_MAX, False)


def main(argv=None) -> int:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName(f"mendlist {args.step}").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
