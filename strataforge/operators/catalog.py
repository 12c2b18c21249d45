"""Library and version catalog: roll-ups, canonical picks, listings, suggestions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import version_key


def canonical_name(name: Column | str) -> Column:
    """Trimmed and in lower case: how libraries and versions are told apart."""
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def version_name(name: Column | str) -> Column:
    """Null and '' both mean unversioned."""
    return F.coalesce(canonical_name(name), F.lit(""))


def version_rollup(libraries: DataFrame, versions: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a version, also without pages: documents, distinct URLs, first page time.

    Chunks and pages are counted by page and version before they meet, so a version with a third of all rows is
    pre-aggregated in every task. Pages and chunks must have one row an id.
    """
    per_page = chunks.groupBy("page_id").agg(F.count("*").alias("n_chunks"))
    docs = pages.select("id", "version_id").join(per_page, F.col("id") == F.col("page_id"), "left").groupBy("version_id").agg(F.sum(F.coalesce("n_chunks", F.lit(0))).alias("documents"))
    seen = pages.groupBy("version_id").agg(F.countDistinct("url").alias("urls"), F.min("created_at").alias("first_at"))
    v = versions.select(F.col("id").alias("version_id"), "library_id", version_name("name").alias("version"), "status")
    names = libraries.select(F.col("id").alias("library_id"), canonical_name("name").alias("library"))
    out = v.join(names, "library_id").join(docs, "version_id", "left").join(seen, "version_id", "left")
    return out.select("library", "version_id", "version", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("urls", F.lit(0)).alias("urls"), "first_at")


def nested_summary(rollup: DataFrame) -> DataFrame:
    """library, versions: an array of structs, unversioned first, then by descending version, then by name."""
    entry = F.struct(*version_key("version"), "version", "documents", "urls")
    return rollup.groupBy("library").agg(F.sort_array(F.collect_list(entry)).alias("e")).select("library", F.transform("e", lambda x: F.struct(x["version"].alias("version"), x["documents"].alias("documents"), x["urls"].alias("urls"))).alias("versions"))


def canonical_unversioned(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """library_id, version_id: of a library's unversioned entries the one with most documents, then the lowest id. `documents`: version_id, documents."""
    u = versions.where(version_name("name") == "").select("library_id", F.col("id").alias("version_id")).join(documents, "version_id", "left")
    return u.groupBy("library_id").agg(F.max_by("version_id", F.struct(F.coalesce("documents", F.lit(0)), -F.col("version_id"))).alias("version_id"))


def _blocks(rows: DataFrame, size: int) -> Iterator[list[str]]:
    found: list[str] = []
    for r in rows.toLocalIterator():
        found.append(r[0])
        if len(found) == size:
            yield found
            found = []
    if found:
        yield found


def did_you_mean(asked: DataFrame, names: DataFrame, k: int = 3, most_share: float = 0.7, broadcast_names: int = 100_000) -> DataFrame:
    """(asked, place, name): the k known names nearest by edit distance, at most `most_share` of the longer name away.

    `names` is a dimension table, sent to every task while it has at most `broadcast_names` rows; a longer one is met by the distinct questions in blocks of that size.
    """
    from pyspark.sql import Window

    far = F.levenshtein("asked", "name")
    near = far <= F.greatest(F.length("asked"), F.length("name")) * most_share
    left, right = asked.select("asked").where("asked is not null").distinct(), names.select("name").where("name is not null").distinct()
    if right.limit(broadcast_names + 1).count() <= broadcast_names:
        pairs = left.join(F.broadcast(right), near)
    else:
        blocks = [left.sparkSession.createDataFrame([(x,) for x in b], "asked string") for b in _blocks(left, broadcast_names)]
        pairs = reduce(DataFrame.unionByName, [right.join(F.broadcast(b), near) for b in blocks]) if blocks else left.join(right, F.lit(False))
    w = Window.partitionBy("asked").orderBy(far, "name")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("asked", "place", "name")
