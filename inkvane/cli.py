"""A thin command line over the library: python -m inkvane.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import analyze, detector, evaluate, experiment, features, splits
from .sources import files

VERSION = "0.1.0"


def _text(args) -> str:
    given = [x is not None for x in (args.text, args.file)].count(True)
    if given != 1:
        sys.exit("give exactly one of --text and --file (- for stdin)")
    return args.text if args.text is not None else sys.stdin.read() if args.file == "-" else open(args.file, encoding="utf-8").read()


def _labelled(spark, path, seed, train):
    records = splits.assign_splits(files.read_jsonl(spark, path), train=train, test=round(1 - train, 12), seed=seed)
    return features.statistical(records.where("label in ('human', 'ai')")).withColumn("y", (F.col("label") == "ai").cast("int"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkvane")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("features", "analyze"):
        c = sub.add_parser(name)
        c.add_argument("--text")
        c.add_argument("--file")
        if name == "analyze":
            c.add_argument("--model", required=True)
    for name in ("train", "evaluate"):
        c = sub.add_parser(name)
        c.add_argument("dataset")
        c.add_argument("model")
        c.add_argument("--seed", type=int, default=0)
        c.add_argument("--train-ratio", type=float, default=0.8)
        if name == "evaluate":
            c.add_argument("--split", default="test", choices=["train", "val", "test", "all"])
    sub.add_parser("experiment").add_argument("config")
    args = p.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    text = _text(args) if args.command in ("features", "analyze") else None
    spark = SparkSession.builder.appName("inkvane").config("spark.ui.enabled", "false").getOrCreate()
    if args.command == "features":
        row = features.statistical(spark.createDataFrame([(text,)], "text string")).drop("text").first()
        print(json.dumps(row.asDict(), indent=1))
    elif args.command == "analyze":
        system = analyze.System("file", detector.Detector.load(args.model))
        row = analyze.analyze(spark.createDataFrame([("text", text)], "id string, text string"), system).first()
        print(json.dumps(row.asDict(recursive=True), indent=1))
        return 1 if row["reason"] else 0
    elif args.command == "train":
        data = _labelled(spark, args.dataset, args.seed, args.train_ratio).where("split = 'train'")
        detector.train(data, features.STATISTICAL, "y", "id", detector.Config(seed=args.seed)).save(args.model)
    elif args.command == "evaluate":
        data = _labelled(spark, args.dataset, args.seed, args.train_ratio)
        data = data if args.split == "all" else data.where(F.col("split") == args.split)
        if not data.limit(1).count():
            print(f"no records in split {args.split}", file=sys.stderr)
            return 1
        scored = detector.Detector.load(args.model).predict(data, "p")
        print(json.dumps(evaluate.document_metrics(scored).first().asDict(), indent=1))
    else:
        cfg = experiment.Config.from_file(args.config)
        print(json.dumps(experiment.run(files.read_jsonl(spark, cfg.dataset), cfg), indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
