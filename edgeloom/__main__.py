"""``python -m edgeloom``: the runs of ``plans.flows`` from a shell; under ``spark-submit`` the session is the cluster's."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from edgeloom.plans import flows


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="edgeloom")
    steps = parser.add_subparsers(dest="step", required=True)
    step = steps.add_parser("compress", help="a text edge list becomes distinct edges with dense ids")
    step.add_argument("source")
    step.add_argument("folder")
    step.add_argument("--drop-self-loops", action="store_true")
    step = steps.add_parser("translate", help="the graph under a vertex order, as binary adjacency both ways")
    step.add_argument("folder")
    step.add_argument("-o", "--order", help="a file of old and new ids")
    step.add_argument("-w", "--block-width", type=int)
    step = steps.add_parser("run", help="blocks of the adjacency, then an algorithm on it; a row of results.csv each time")
    step.add_argument("folder")
    step.add_argument("-m", "--most", type=int, required=True, help="edges from which on a square is quartered")
    step.add_argument("-a", "--algorithm", default="pr", choices=sorted(flows.ALGORITHMS))
    step.add_argument("-i", "--iterations", type=int, default=10)
    step.add_argument("-e", "--experiments", type=int, default=1, help="how often")
    step.add_argument("-d", "--dumps", action="store_true", help="write blocks, their edges and their index")
    step.add_argument("-s", "--scores", help="a folder for what the last experiment has found, as Parquet")
    return parser


def main(given: list[str] | None = None) -> None:
    options = arguments().parse_args(given)
    spark = SparkSession.builder.appName("edgeloom").getOrCreate()
    if options.step == "compress":
        print(flows.canonicalise(spark, options.source, options.folder, options.drop_self_loops))
    elif options.step == "translate":
        print(flows.translate(spark, options.folder, options.order, options.block_width))
    else:
        found = None
        for _ in range(options.experiments):
            numbers, found = flows.block_and_rank(spark, options.folder, options.most, options.algorithm, options.iterations, options.dumps)
            print(flows.shown_info(options.folder, numbers))
        if options.scores and found is not None:
            found.write.mode("overwrite").parquet(options.scores)


if __name__ == "__main__":
    main()
