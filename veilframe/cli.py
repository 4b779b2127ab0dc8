"""``python -m veilframe.cli CONFIG OUTPUT FILE...``: run a configured pipeline and write its frames.

As JSON lines, a folder a frame; with ``--documents`` as single documents under their
published names. Row counts go to standard error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from veilframe.config import OPERATIONS, Config
from veilframe.pipelines import anonymize
from veilframe.sources import readers, sinks

def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config")
    parser.add_argument("output")
    parser.add_argument("files", nargs="+")
    parser.add_argument("--format", default="json", choices=["json", "jsonl", "parquet"])
    parser.add_argument("--dataset", choices=["medical", "spatioTemporal"], help="another dataset than the configuration's data_type")
    parser.add_argument("--operation", action="append", default=[], choices=OPERATIONS, help="only this one; may be repeated")
    parser.add_argument("--query", choices=["count", "mean"], help="preset of the private query")
    parser.add_argument("--documents", action="store_true")
    given = parser.parse_args(args)
    config = Config.load(given.config, dataset=given.dataset, operations=tuple(given.operation), query=given.query)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df, seen = readers.read(spark, given.files, given.format, with_file=True), {}
    frames = anonymize.run(df, config, seen=seen)
    if given.documents:
        sinks.publish(frames, config, given.output)
    else:
        for name, frame in frames.items():
            sinks.write_lines(frame, f"{given.output}/{name}")
    for name, noted in seen.items():
        print(f"{name}: {noted.get}", file=sys.stderr)


if __name__ == "__main__":
    main()
