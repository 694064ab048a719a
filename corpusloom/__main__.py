"""Command line: analyse papers, many data sets or one document, simulate a review, ranks and recall of a screening log, statistics of datasets, validate datasets, encode texts.

    python -m corpusloom analyze papers.parquet out --references refs.parquet --embeddings vectors.parquet [--rrf]
    python -m corpusloom document papers.parquet out 17 --references refs.parquet --embeddings vectors.parquet [--rrf]
    python -m corpusloom datasets papers.parquet out --references refs.parquet --embeddings vectors.parquet --baselines ranks.parquet [--rrf]
    python -m corpusloom review papers.parquet out --learner nb --batch 50 --patience 100 [--stopper last_relevant] [--settings tuned]
    python -m corpusloom ranks log.parquet out --targets 17 42 --patience 100
    python -m corpusloom recall log.parquet out
    python -m corpusloom describe scores.parquet features.parquet out
    python -m corpusloom validate datasets.json folder
    python -m corpusloom encode papers.parquet out
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.columns import embedding_text
from .operators import evaluation, many, screening, summary
from .operators.detector import CitationOutlierDetector
from .plans.materialize import release
from .session import ship_by_value
from .sources import datasets


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze")
    document = commands.add_parser("document")
    together = commands.add_parser("datasets")
    for command, tables in ((analyze, ("references", "corpus", "embeddings")), (document, ("references", "corpus", "embeddings")), (together, ("references", "embeddings", "baselines"))):
        command.add_argument("papers")
        command.add_argument("out")
        for name in tables:
            command.add_argument(f"--{name}")
        command.add_argument("--rrf", "--RRF", action="store_true")
    analyze.add_argument("--top-k", type=int, default=10)
    document.add_argument("id", type=int)
    review = commands.add_parser("review")
    review.add_argument("papers")
    review.add_argument("out")
    review.add_argument("--learner", choices=screening.LEARNERS, default="nb")
    for name, default in (("batch", 50), ("rounds", None), ("patience", 100)):
        review.add_argument(f"--{name}", type=int, default=default)
    review.add_argument("--stopper", choices=("consecutive", "last_relevant"), default="consecutive")
    review.add_argument("--settings", choices=sorted(screening.SETTINGS), default="plain")
    ranks = commands.add_parser("ranks")
    recall = commands.add_parser("recall")
    for command in (ranks, recall):
        command.add_argument("log")
        command.add_argument("out")
    ranks.add_argument("--targets", type=int, nargs="+", required=True)
    ranks.add_argument("--patience", type=int, default=100)
    describe = commands.add_parser("describe")
    for name in ("scores", "features", "out"):
        describe.add_argument(name)
    validate = commands.add_parser("validate")
    validate.add_argument("config")
    validate.add_argument("folder")
    encode = commands.add_parser("encode")
    encode.add_argument("papers")
    encode.add_argument("out")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    ship_by_value()
    read = lambda path: spark.read.parquet(path) if path else None
    if args.command == "analyze":
        detector = CitationOutlierDetector(use_rrf=args.rrf)
        detector.fit(read(args.papers), read(args.references), read(args.corpus), read(args.embeddings)).write.mode("overwrite").parquet(f"{args.out}/scores")
        datasets.save_report(detector.top_outliers(top_k=args.top_k), f"{args.out}/top")
        print(datasets.text_report(detector.method_comparison(), "Methods"))
    elif args.command == "document":
        detector = CitationOutlierDetector(use_rrf=args.rrf)
        detector.fit(read(args.papers), read(args.references), read(args.corpus), read(args.embeddings))
        text = datasets.sectioned_report(f"Document {args.id}", summary.document_sections(detector, args.id))
        datasets.save_text(spark, text, args.out)
        print(text)
    elif args.command == "datasets":
        found = many.analyze_together(read(args.papers), read(args.references), read(args.embeddings), use_rrf=args.rrf)
        found.scores.write.mode("overwrite").parquet(f"{args.out}/scores")
        found.features.write.mode("overwrite").parquet(f"{args.out}/features")
        datasets.save_report(found.status, f"{args.out}/status")
        written = many.Analysis(found.status, read(f"{args.out}/features"), read(f"{args.out}/scores"))
        importances = summary.importances_by_dataset(written.features, written.scores)
        datasets.save_report(importances, f"{args.out}/importances")
        text = datasets.sectioned_report("Data sets", summary.dataset_sections(written, read(args.baselines), importances))
        datasets.save_text(spark, text, f"{args.out}/report")
        print(text)
    elif args.command == "review":
        order = screening.simulate_review(read(args.papers), args.learner, args.batch, args.rounds, patience=args.patience, stopper=args.stopper, settings=args.settings)
        log = order.select(F.col("id").alias("record_id"), "label", F.col("review_order").alias("time"))
        order.write.mode("overwrite").parquet(f"{args.out}/order")
        print(datasets.text_report(screening.stopping_point(log, args.patience), "Stop"))
    elif args.command == "ranks":
        targets = spark.createDataFrame([(t,) for t in args.targets], "record_id bigint")
        datasets.save_report(screening.leftover_ranks(read(args.log), targets, args.patience), args.out)
    elif args.command == "recall":
        screening.recall_curve(read(args.log)).write.mode("overwrite").option("header", True).csv(args.out)
    elif args.command == "describe":
        datasets.save_report(evaluation.dataset_statistics(read(args.scores), read(args.features)), args.out)
    elif args.command == "validate":
        config = datasets.load_config(spark, args.config)
        found = {name: datasets.validate(spark, config, name, args.folder) for name in datasets.dataset_names(config)}
        print("\n".join(f"{name}: {'ok' if ok else 'not usable'}" for name, ok in found.items()))
        return int(not all(found.values()))
    else:
        papers = read(args.papers)
        texts = papers.select("id", embedding_text(F.col("title"), F.col("abstract")).alias("text"))
        datasets.save_embeddings(datasets.encode(texts, datasets.hashing_encoder), args.out)
    release(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
