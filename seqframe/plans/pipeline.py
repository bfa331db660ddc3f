"""Steps whose results are kept: a step runs again only if its input or its parameters changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = ".step.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, paths: list[str], parameters: dict) -> str:
    """Of the inputs' files (names, sizes, times) and the parameters."""
    seen = []
    for path in sorted(paths):
        fs, p = _fs(spark, path)
        for f in fs.globStatus(p) or []:
            files = [f] if f.isFile() else [x for x in fs.listStatus(f.getPath()) if x.isFile()]
            seen += sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in files)
    return hashlib.sha256(json.dumps([seen, parameters], sort_keys=True, default=str).encode()).hexdigest()


def run_step(spark: SparkSession, output: str, inputs: list[str], parameters: dict, step: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, bool]:
    """(the step's table, whether it ran). The table is Parquet at `output`, with the fingerprint beside it."""
    print_ = fingerprint(spark, inputs, parameters)
    fs, at = _fs(spark, f"{output}{MANIFEST}")
    if not force and fs.exists(at):
        with_ = spark.read.option("wholetext", True).text(f"{output}{MANIFEST}").first()["value"]
        if json.loads(with_)["fingerprint"] == print_:
            return spark.read.parquet(output), False
    step().write.mode("overwrite").parquet(output)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({"fingerprint": print_, "parameters": parameters}, default=str).encode()))
    out.close()
    return spark.read.parquet(output), True
