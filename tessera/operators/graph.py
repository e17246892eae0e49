"""Call graphs as edge tables: target resolution and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) for every node that edges (caller, callee) lead to from starts (start), itself included; cycles are legal.

    Semi-naive: each round joins only the pairs that the last one found, and leaves out those known. Rounds are tables, so lost executors cost no history.
    """
    edges = stored(edges.select("caller", "callee").distinct(), "edges")
    seen = delta = stored(starts.select("start", F.col("start").alias("node")).distinct(), "reached")
    while True:
        new = delta.join(edges, delta.node == edges.caller).select("start", F.col("callee").alias("node")).distinct()
        delta = stored(new.join(seen, ["start", "node"], "left_anti"), "delta")
        if delta.isEmpty():
            return seen
        seen = stored(seen.unionByName(delta), "reached")


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (file, caller, name) -> callee as file::function: of the same file if it is defined there, else of an imported file, else the bare name.

    The name's last segment is what is looked up, in imports (file, target) in their order of name.
    """
    last = F.element_at(F.split("name", r"\."), -1)
    c = calls.withColumn("fn", last)
    f = functions.select(F.col("file").alias("def_file"), F.col("name").alias("fn"))
    own = f.withColumnRenamed("def_file", "file").withColumn("own", F.lit(True))
    foreign = imports.join(f, imports.target == f.def_file).groupBy("file", "fn").agg(F.min("target").alias("target"))
    out = c.join(own, ["file", "fn"], "left").join(foreign, ["file", "fn"], "left")
    callee = F.when(F.col("own"), F.concat_ws("::", "file", "fn")).when(F.col("target").isNotNull(), F.concat_ws("::", "target", "fn")).otherwise(F.col("name"))
    return out.select(F.concat_ws("::", "file", "caller").alias("caller"), callee.alias("callee")).distinct()


def merged_contexts(primary: DataFrame, supplemental: DataFrame, key: list[str], order: str) -> DataFrame:
    """Both tables, the first one's row where both have a key, and of the second's the first for each key."""
    once = supplemental.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(order))).filter("_k = 1").drop("_k")
    return primary.unionByName(once.join(primary.select(*key), key, "left_anti").select(primary.columns))


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports (file, name) -> (file, target) for modules that are files of paths (path): of a dotted name and its beginnings the longest that is one, as a module
    or a package; a name that begins with dots is looked up from the importing file's folder."""
    dots = F.length(F.regexp_extract("name", r"^\.*", 0))
    folder = F.slice(F.split("file", "/"), F.lit(1), F.greatest(F.size(F.split("file", "/")) - F.greatest(dots, F.lit(1)), F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace("name", r"^\.+", ""), r"\."), lambda x: x != "")
    whole = F.when(dots > 0, F.concat(folder, rest)).otherwise(rest)
    i = imports.select("file", "name", whole.alias("parts")).filter("size(parts) > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts"))))
    base = F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/")
    i = i.withColumn("path", F.explode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))))
    best = i.join(paths.select("path"), "path").groupBy("file", "name").agg(F.max_by("path", F.struct("n", F.length("path"))).alias("target"))
    return best.filter("target <> file").select("file", "target").distinct()


def cross_file(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges (caller, callee), as file::function, from one file into another among what the starts reach."""
    nodes = reachable(edges, starts).select(F.col("node").alias("caller")).distinct()
    file = lambda c: F.substring_index(c, "::", 1)
    return edges.join(nodes, "caller", "left_semi").filter(F.contains("callee", F.lit("::")) & (file("caller") != file("callee"))).distinct()
