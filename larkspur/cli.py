"""Command line: python -m larkspur.cli {query,inspect,tree,convert,segments} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="larkspur")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in (("query", ["path", "sql"]), ("inspect", ["path"]), ("tree", ["path"]), ("convert", ["source", "target"]), ("segments", ["path"])):
        command = commands.add_parser(name)
        for word in words:
            command.add_argument(word)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    if args.command == "query":
        spark.read.parquet(args.path).createOrReplaceTempView("data")
        spark.sql(args.sql).show(100, truncate=False)
    elif args.command == "tree":
        spark.read.parquet(args.path).printSchema()
    elif args.command == "convert":
        form = next((f for f in ("csv", "json", "orc") if args.source.endswith(f".{f}")), "parquet")
        reader = spark.read.option("header", True) if form == "csv" else spark.read
        reader.format(form).load(args.source).write.parquet(args.target)
    else:
        df = spark.read.parquet(args.path)
        meta = df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        if args.command == "segments":
            meta = df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        meta.agg(F.count(F.lit(1)).alias("rows")).orderBy("file").show(1000, truncate=False)


if __name__ == "__main__":
    main()
