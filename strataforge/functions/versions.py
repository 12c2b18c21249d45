"""Semantic versions: parsing, ordering, ranges and the choice of the best version."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import total_ordering

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The grammar of a semantic version, with and without missing parts.
VERSION = re.compile(r"^[v=\s]*(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?$")
PARTIAL = re.compile(r"^v?(\d+)(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?$")
LOOSE = re.compile(r"(?:^|\D)(\d{1,16})(?:\.(\d{1,16}))?(?:\.(\d{1,16}))?(?:\D|$)")


@total_ordering
@dataclass(frozen=True)
class Version:
    major: int
    minor: int
    patch: int
    pre: tuple[str, ...] = ()

    def key(self) -> tuple:
        # A release comes after its prereleases; numeric identifiers sort before words and by value.
        return (self.major, self.minor, self.patch, not self.pre, tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in self.pre))

    def __lt__(self, other: Version) -> bool:
        return self.key() < other.key()

    @property
    def core(self) -> tuple[int, int, int]:
        return (self.major, self.minor, self.patch)


def parse(text: str | None) -> Version | None:
    m = VERSION.match(text.strip()) if text else None
    return Version(int(m[1]), int(m[2]), int(m[3]), tuple(m[4].split(".")) if m[4] else ()) if m else None


def coerce(text: str | None) -> Version | None:
    """The version itself, or the first number run read as one (`2.4` is 2.4.0)."""
    if (v := parse(text)) is not None:
        return v
    m = LOOSE.search(text) if text else None
    return Version(int(m[1]), int(m[2] or 0), int(m[3] or 0)) if m else None


def in_range(v: Version, target: str) -> bool:
    """Whether v is the exact target or below it, or lies in an X, X.Y, X.x or * range. Prereleases match only an exact target's own core."""
    exact = parse(target)
    if exact is not None:
        return v <= exact and (not v.pre or v == exact or (bool(exact.pre) and v.core == exact.core))
    m = PARTIAL.match(target.strip()) if target.strip() not in ("*", "") else None
    if target.strip() in ("*", ""):
        return not v.pre
    if not m or v.pre or v.major != int(m[1]):
        return False
    return all(p is None or p in "xX*" or have == int(p) for p, have in ((m[2], v.minor), (m[3], v.patch)))


def best(versions: list[str | None], target: str | None) -> str | None:
    """The greatest stored version that suits the target: none or `latest` take the greatest stable one; odd targets match nothing."""
    wanted = (target or "").strip().lower()
    if wanted in ("", "latest"):
        wanted = "*"
    if wanted != "*" and parse(wanted) is None and PARTIAL.match(wanted) is None:
        return None
    fit = [(v, s) for s in versions if s and (v := parse(s)) is not None and in_range(v, wanted)]
    return max(fit, key=lambda x: (x[0], x[1]))[1] if fit else None


def version_parts(name: Column | str) -> list[Column]:
    """major, minor, patch as numbers by built-in expressions; null where the name is not a full version."""
    c = F.col(name) if isinstance(name, str) else name
    full = c.rlike(r"^[v=\s]*\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$")
    return [F.when(full, F.regexp_extract(c, r"^[v=\s]*(\d+)\.(\d+)\.(\d+)", i).cast("bigint")) for i in (1, 2, 3)]


def version_key(name: Column | str) -> list[Column]:
    """Ascending sort columns: unversioned first, versions from the greatest down (releases before their prereleases), other names last, by name."""
    c = F.col(name) if isinstance(name, str) else name
    a, b, p = version_parts(c)
    kind = F.when(F.coalesce(c, F.lit("")) == "", 0).when(a.isNotNull(), 1).otherwise(2)
    return [kind.alias("k0"), (-F.coalesce(a, F.lit(0))).alias("k1"), (-F.coalesce(b, F.lit(0))).alias("k2"), (-F.coalesce(p, F.lit(0))).alias("k3"), F.when(a.isNotNull() & c.contains("-"), 1).otherwise(0).alias("k4")]


def best_versions(versions: DataFrame, target: str | None) -> DataFrame:
    """(library_id, best, has_unversioned) for every library; `best` is null where nothing suits. `versions`: library_id, name, a small dimension."""

    @F.pandas_udf(T.StringType())
    def choose(names: pd.Series) -> pd.Series:
        return names.map(lambda xs: best(list(xs), target))

    g = versions.groupBy("library_id").agg(F.collect_list("name").alias("names"), F.max(F.coalesce("name", F.lit("")) == "").alias("has_unversioned"))
    return g.select("library_id", choose("names").alias("best"), "has_unversioned")
