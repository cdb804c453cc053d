"""python -m quarry COMMAND ...: build, look into, merge and search published indexes.

    create INDEX TREE          index the files below a folder (package_version/path)
    merge INDEX FROM...        one index of several with disjoint paths
    du INDEX                   bytes of each version
    docids INDEX               (docid, path)
    trigram INDEX TRI          files and places of a trigram
    posting INDEX TRI          its docids, with the differences
    matches INDEX TRI          its path:place
    search INDEX TREE QUERY    ranked lines
    replay INDEX TREE LOG      a JSON line for each query of a log: files searched, seconds, matches
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import human_bytes
from .operators import postings, results, store
from .search import plan, search
from .sources import corpus


def corpus_of(spark: SparkSession, tree: str) -> DataFrame:
    """(docid, path, content) of the admitted files below a folder; docids follow the paths."""
    files = corpus.from_tree(spark, tree, trim=tree.rstrip("/") + "/", ignored=corpus.SKIPPED_DIRS)
    files = files.where(corpus.path_rejection(F.col("path"), F.col("size")).isNull())
    files = files.withColumn("docid", F.xxhash64("path"))
    counted = files.join(postings.distinct_trigrams(files), "docid")
    admitted, _ = corpus.admitted(counted, F.col("n_trigrams"))
    # numbers by path: each range of paths counts for itself, and only the counts are summed in one place
    ranged = admitted.select("path", F.col("content").cast("string").alias("content"), F.substring(F.md5("path"), 1, 2).alias("range"))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))
    placed = ranged.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("path")) - 1)
    return placed.join(bases, "range").select((F.col("base") + F.col("k")).alias("docid"), "path", "content")


def merge(spark: SparkSession, folder: str, sources: list[str]) -> str:
    """Publish one index of several: docids are moved beyond those of the indexes before."""
    base, files, lists = 0, [], []
    for source in sources:
        here = store.files(spark, source)
        files.append(here.withColumn("docid", F.col("docid") + base))
        lists.append(store.index(spark, source).withColumn("docid", F.col("docid") + base))
        base += (here.agg(F.max("docid")).first()[0] or 0) + 1

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def write(path: str) -> None:
        union(files).write.parquet(f"{path}/files")
        union(lists).write.parquet(f"{path}/postings")  # the lists keep their order, and aren't moved

    return store.publish(spark, folder, write)


def replay(spark: SparkSession, index: str, tree: str, queries: list[str]) -> list[dict]:
    """What each query of a log costs: files that its trigrams leave, seconds, matching lines."""
    files, lists, out = corpus_of(spark, tree).persist(), store.index(spark, index), []
    for query in queries:
        began = time.perf_counter()
        searched = postings.candidates(lists, plan(query)[2], files).count()
        found = search(files, query, index=lists).count()
        out.append({"query": query, "files": searched, "matches": found, "seconds": round(time.perf_counter() - began, 3)})
    files.unpersist()
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m quarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices="create merge du docids trigram posting matches search replay".split())
    parser.add_argument("index")
    parser.add_argument("rest", nargs="*")
    args = parser.parse_args(argv)
    wanted = {"create": 1, "du": 0, "docids": 0, "trigram": 1, "posting": 1, "matches": 1, "search": 2, "replay": 2}
    if args.command in wanted and len(args.rest) != wanted[args.command] or args.command == "merge" and not args.rest:
        parser.error(f"{args.command} takes {wanted.get(args.command, 'some')} more arguments")
    spark = spark or SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    rest = args.rest
    if args.command == "create":
        print(store.publish_index(corpus_of(spark, rest[0]), args.index))
        return 0
    if args.command == "merge":
        print(merge(spark, args.index, rest))
        return 0
    if args.command == "replay":
        with open(rest[1], encoding="utf-8") as log:
            for row in replay(spark, args.index, rest[0], [line.rstrip("\n") for line in log if line.strip()]):
                print(json.dumps(row))
        return 0
    if args.command == "du":
        rows = store.sizes(spark, args.index).select("version", "part", human_bytes(F.col("bytes")), "current")
    elif args.command == "docids":
        rows = store.files(spark, args.index).orderBy("docid")
    elif args.command == "search":
        ranked = search(corpus_of(spark, rest[0]), rest[1], index=store.index(spark, args.index))
        rows = results.top(ranked).select("path", "line", "context", "rank")
    else:
        index, trigram = store.index(spark, args.index), rest[0].encode()
        if args.command == "trigram":
            rows = postings.trigram_meta(postings.listed(index, [trigram]))
        elif args.command == "posting":
            rows = postings.posting_deltas(index, trigram)
        else:
            rows = postings.positions_of(index, trigram).join(store.files(spark, args.index), "docid").select("path", "pos")
    for row in rows.toLocalIterator():
        print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
