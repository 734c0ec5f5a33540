"""Session factory and engine options."""

from __future__ import annotations

import logging
import os
import tempfile
import zipfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


#: Where a session keeps the options that operators read.
STRATEGY, SEED = "spark.edgeloom.strategy", "spark.edgeloom.seed"


@dataclass(frozen=True)
class Options:
    """What callers may choose; Spark decides everything else."""

    strategy: str = "auto"  # of triangle counts: auto, array, wedge, bitmap, blocks, spgemm, degree
    partitions: int | None = None  # of shuffles; None: Spark's own setting
    seed: int | None = None  # of the random start of cross decomposition; None: id modulo parts


def init(options: Options = Options(), master: str | None = None, level: str = "WARN") -> SparkSession:
    """A session with adaptive execution; repeated calls give the same one."""
    builder = SparkSession.builder.appName("edgeloom").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if options.partitions:
        builder = builder.config("spark.sql.shuffle.partitions", options.partitions)
    session = builder.getOrCreate()
    session.conf.set(STRATEGY, options.strategy)
    if options.seed is not None:
        session.conf.set(SEED, options.seed)
    session.sparkContext.setLogLevel(level)
    logging.getLogger("edgeloom").setLevel(level)
    return session


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that they need no installation."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}_{sc.applicationId}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
