"""The index manifest beside the tables: format version, model, and ordered migrations as DataFrame rewrites."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Migration = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def _path(spark: SparkSession, root: str, name: str = "manifest.json"):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read(spark: SparkSession, root: str) -> dict[str, str]:
    fs, p = _path(spark, root)
    if not fs.exists(p):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(p.toString()).collect()))


def write(spark: SparkSession, root: str, values: dict[str, str]) -> None:
    """Written aside and renamed into place, so readers see the old or the new one."""
    fs, target = _path(spark, root)
    _, aside = _path(spark, root, "manifest.json.new")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(values).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(aside, target)


def migrate(spark: SparkSession, root: str, migrations: list[Migration], tables: list[str]) -> int:
    """Apply the migrations not yet recorded, in order, each to a new folder of tables; returns the format version reached.

    `root/v<n>/<table>` are the tables of version n; the manifest names n only after all its tables are written.
    """
    m = read(spark, root)
    version = int(m.get("version", 0))
    for n, step in enumerate(migrations[version:], version + 1):
        old = {t: spark.read.parquet(f"{root}/v{n - 1}/{t}") for t in tables}
        for t, df in step(old).items():
            df.write.mode("overwrite").parquet(f"{root}/v{n}/{t}")
        m["version"] = str(n)
        write(spark, root, m)
        version = n
    return version
