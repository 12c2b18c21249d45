"""Context of found chunks in a page's heading tree: parents, siblings, children, ancestors, subtrees, and reassembly.

All seeds are expanded at once by equi-joins on the page and a path, so the chunk table is read once for each relation and a large
page or version is spread by (page, path). Chunks have id, page_id, path, types, sort_order, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent_path(path: Column) -> Column:
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def _seed(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col("id").alias("seed_id"), "page_id", F.col("path").alias("seed_path"), F.col("sort_order").alias("seed_order"))


def _limited(found: DataFrame, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("seed_id").orderBy(*order)
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def parents(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """(seed_id, id): the nearest earlier chunk of the page whose path is the seed's without its last element. A pathless seed has none."""
    s = _seed(seeds).where(F.size("seed_path") > 0).withColumn("path", parent_path(F.col("seed_path")))
    j = s.join(chunks.select("page_id", "path", "id", "sort_order"), ["page_id", "path"]).where(F.col("sort_order") < F.col("seed_order"))
    return j.groupBy("seed_id").agg(F.max_by("id", F.struct("sort_order", "id")).alias("id"))


def siblings(seeds: DataFrame, chunks: DataFrame, before: int = 1, after: int = 2) -> tuple[DataFrame, DataFrame]:
    """(seed_id, id) of the nearest chunks with the same path: up to `before` earlier and `after` later ones."""
    j = _seed(seeds).withColumnRenamed("seed_path", "path").join(chunks.select("page_id", "path", "id", "sort_order"), ["page_id", "path"])
    earlier = _limited(j.where(F.col("sort_order") < F.col("seed_order")), before, F.desc("sort_order"), F.desc("id"))
    later = _limited(j.where(F.col("sort_order") > F.col("seed_order")), after, F.asc("sort_order"), F.asc("id"))
    return earlier.select("seed_id", "id"), later.select("seed_id", "id")


def children(seeds: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(seed_id, id): the first k later chunks whose path extends the seed's by one element."""
    kids = chunks.where(F.size("path") > 0).select("page_id", parent_path(F.col("path")).alias("seed_path"), "id", "sort_order")
    j = _seed(seeds).join(kids, ["page_id", "seed_path"]).where(F.col("sort_order") > F.col("seed_order"))
    return _limited(j, k, F.asc("sort_order"), F.asc("id")).select("seed_id", "id")


def ancestors(seeds: DataFrame, chunks: DataFrame, most: int = 10) -> DataFrame:
    """(seed_id, depth, id): for each proper prefix of the seed's path the first chunk that has it; prefixes nobody has are passed over."""
    s = _seed(seeds).withColumn("depth", F.explode(F.sequence(F.lit(0), F.greatest(F.size("seed_path") - 1, F.lit(0))))).where((F.col("depth") < F.size("seed_path")) & (F.col("depth") >= F.size("seed_path") - most))
    j = s.withColumn("path", F.slice("seed_path", 1, F.col("depth"))).join(chunks.select("page_id", "path", "id", "sort_order"), ["page_id", "path"])
    return j.groupBy("seed_id", "depth").agg(F.min_by("id", F.struct("sort_order", "id")).alias("id"))


def nearest_ancestor(seeds: DataFrame, chunks: DataFrame, kind: str | None = None) -> DataFrame:
    """(seed_id, id): the deepest ancestor, of chunks whose types contain `kind` if given."""
    pool = chunks.where(F.array_contains("types", kind)) if kind else chunks
    return ancestors(seeds, pool, 1_000).groupBy("seed_id").agg(F.max_by("id", "depth").alias("id"))


def subtrees(seeds: DataFrame, chunks: DataFrame, most: int = 1_000) -> DataFrame:
    """(seed_id, id): chunks at or after the seed whose path starts with the seed's, at most `most` for each level below it."""
    under = chunks.withColumn("d", F.explode(F.sequence(F.lit(0), F.size("path")))).select("page_id", F.slice("path", 1, F.col("d")).alias("seed_path"), "id", "sort_order", (F.size("path") - F.col("d")).alias("level"))
    j = _seed(seeds).join(under, ["page_id", "seed_path"]).where(F.col("sort_order") >= F.col("seed_order"))
    w = Window.partitionBy("seed_id", "level").orderBy("sort_order", "id")
    return j.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("seed_id", "id")


def common_prefix(paths: Column) -> Column:
    """The longest common prefix of an array of paths; empty for none."""
    shared = lambda a, b: F.slice(a, 1, F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)) - 1, F.lit(0)).cast("int"))
    whole = lambda a, b: F.when(F.exists(F.zip_with(a, b, lambda x, y: ~F.coalesce(x == y, F.lit(False))), lambda z: z), shared(a, b)).otherwise(a)
    return F.when(F.size(paths) > 0, F.aggregate(F.slice(paths, 2, F.greatest(F.size(paths) - 1, F.lit(0))), paths[0], whole)).otherwise(F.array().cast("array<string>"))


def expand_markdown(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """(seed_id, id), each once: the seed, its parent, one earlier and two later siblings and three children."""
    before, after = siblings(seeds, chunks)
    own = seeds.select(F.col("id").alias("seed_id"), "id")
    return own.unionByName(parents(seeds, chunks)).unionByName(before).unionByName(after).unionByName(children(seeds, chunks)).distinct()


def expand_hierarchical(seeds: DataFrame, chunks: DataFrame) -> DataFrame:
    """(seed_id, id), each once: the seed, its chain of ancestors, and the subtree of its nearest structural ancestor, else of its top one."""
    chain = ancestors(seeds, chunks)
    structural = nearest_ancestor(seeds, chunks, "structural").select("seed_id", F.col("id").alias("s"))
    highest = chain.groupBy("seed_id").agg(F.min_by("id", "depth").alias("t"))
    root = highest.join(structural, "seed_id", "full_outer").select("seed_id", F.coalesce("s", "t").alias("id"))
    bodies = root.join(chunks.select("id", "page_id", "path", "sort_order"), "id")
    below = subtrees(bodies.select("id", "page_id", "path", "sort_order").distinct(), chunks).withColumnRenamed("seed_id", "root_id")
    tree = root.withColumnRenamed("id", "root_id").join(below, "root_id").select("seed_id", "id")
    return seeds.select(F.col("id").alias("seed_id"), "id").unionByName(chain.select("seed_id", "id")).unionByName(tree).distinct()


def assemble(found: DataFrame, chunks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(seed_id, content): the contents of (seed_id, id) in page order, joined. Nulls are left out."""
    parts = found.join(chunks.select("id", "sort_order", "content"), "id").where(F.col("content").isNotNull())
    g = parts.groupBy("seed_id").agg(F.sort_array(F.collect_list(F.struct("sort_order", "id", "content"))).alias("c"))
    return g.select("seed_id", F.array_join(F.transform("c", lambda x: x["content"]), separator).alias("content"))


def strategy(content_type: Column) -> Column:
    """How a result is put together: source code and JSON by hierarchy, everything else as prose."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(t.rlike(r"json|javascript|typescript|x-python|x-java|x-c|x-go|x-rust|x-ruby|x-php|source|x-sh"), "hierarchical").otherwise("markdown")
