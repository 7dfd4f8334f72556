"""What the jobs share: their config and their command lines."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object, read by Spark as any other input."""
    return json.loads("".join(row.value for row in spark.read.text(path, wholetext=True).limit(1).collect()))


def beside(module: str, name: str) -> dict:
    """The config file that comes with a job."""
    with open(os.path.join(os.path.dirname(module), name)) as lines:
        return json.load(lines)


def command_line(doc: str, paths: dict[str, str]) -> argparse.Namespace:
    """Arguments of a job: its paths and, if another than its own is wanted, a config file."""
    parser = argparse.ArgumentParser(description=doc.split("\n")[0])
    for name, said in paths.items():
        parser.add_argument(f"--{name}", required=True, help=said)
    parser.add_argument("--config", help="JSON config instead of the one beside the job")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return args
