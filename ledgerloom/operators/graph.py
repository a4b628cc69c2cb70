"""References and includes: resolution, unresolved ones, discovery by level, topological order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.lineage import cut
from ledgerloom.operators.sequences import first_occurrence


def resolved(references: DataFrame, labels: DataFrame, key: str, order: list[str], default: str = "??") -> DataFrame:
    """references with `target` (the first label's value) and `resolved`; unknown keys get the default (JN9, JN13)."""
    first = first_occurrence(labels, [key], order)
    met = references.join(first.select(key, F.col("value").alias("__v")), key, "left")
    return met.withColumn("resolved", F.col("__v").isNotNull()).withColumn("target", F.coalesce("__v", F.lit(default))).drop("__v")


def unresolved(references: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """References to no label (JN10)."""
    return references.join(labels.select(key).distinct(), key, "left_anti")


def missing_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (parent, child) to a child that is no node: includes of files that aren't there (GR1)."""
    return edges.join(nodes.select(F.col("node").alias("child")).distinct(), "child", "left_anti")


def include_levels(edges: DataFrame, roots: DataFrame, most: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, depth): the longest way from a root to each node over edges (parent, child); (depth, node) is a topological order.

    One join a level, each level kept before the next begins; more levels than there are nodes, or than `most`, mean a cycle
    (GR1, GR2, SO8).  Nodes reached twice aren't cycles (Z4).  Given all nodes, an edge to none of them is an error.
    """
    if nodes is not None and (lost := missing_targets(edges, nodes).limit(5).collect()):
        raise ValueError("includes of files that aren't there: " + ", ".join(f"{r['parent']} -> {r['child']}" for r in lost))
    if most is None:
        most = edges.select("parent").union(edges.select("child")).distinct().count()
    edges, level, found = cut(edges.select("parent", "child").distinct()), cut(roots.select("node", F.lit(0).alias("depth")).distinct()), None
    for depth in range(1, most + 2):
        found = level if found is None else found.union(level)
        level = cut(level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct())
        if level.isEmpty():
            return found.groupBy("node").agg(F.max("depth").alias("depth"))
    raise ValueError(f"includes are nested more than {most} deep, or in a cycle")


def aliased(figures: DataFrame, assets: DataFrame, path: str = "path") -> DataFrame:
    """figures (path) with `asset`: the asset of that very path, else the first, by path, of that file name (JN21)."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    whole = assets.select(F.col("path").alias("__p")).distinct()
    named = assets.groupBy(name(F.col("path")).alias("__n")).agg(F.min("path").alias("__first"))
    met = figures.join(whole, F.col(path) == F.col("__p"), "left").join(named, name(F.col(path)) == F.col("__n"), "left")
    return met.withColumn("asset", F.coalesce("__p", "__first")).drop("__p", "__n", "__first")


def merged_maps(kept: Column, added: Column) -> Column:
    """Two maps as one; where both have a key, `kept` holds (SE4)."""
    return F.map_concat(F.map_filter(added, lambda k, _: ~F.map_contains_key(kept, k)), kept)


def first_existing(targets: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """targets (base, target) with `path`: the first of the candidates base/target, then with each extension, that exists (JN22)."""
    joined = F.when(F.col("base") == "", F.col("target")).otherwise(F.concat_ws("/", "base", "target"))
    candidates = targets.select("base", "target", F.posexplode(F.array(joined, *[F.concat(joined, F.lit(e)) for e in extensions])).alias("rank", "path"))
    hits = candidates.join(files.select("path").distinct(), "path").groupBy("base", "target").agg(F.min_by("path", "rank").alias("path"))
    return targets.join(hits, ["base", "target"], "left")


def spliced(files: DataFrame) -> DataFrame:
    r"""files (project, path, text) with each \input{path} replaced by that file's text, the innermost first (ST23).

    A round replaces the includes of files that hold none themselves, until nothing is left to replace; files in a cycle
    and includes of files that aren't there keep their commands (Z4).
    """
    from ledgerloom.functions.text import command_arguments

    now = cut(files.select("project", "path", "text"))
    while True:
        called = now.select("project", "path", F.explode(F.array_distinct(command_arguments(F.col("text"), "(?:input|include)"))).alias("child"))
        done = now.filter(F.size(command_arguments(F.col("text"), "(?:input|include)")) == 0).select(
            "project",
            F.col("path").alias("child"),
            F.col("text").alias("inner")
        )
        ready = called.join(done, ["project", "child"]).groupBy("project", "path").agg(F.map_from_entries(F.collect_list(F.struct("child", "inner"))).alias("inner"))
        if ready.isEmpty():
            return now
        quoted = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
        put = lambda text, e: F.regexp_replace(text, F.concat(F.lit(r"\\(?:input|include)\{\Q"), e["key"], F.lit(r"\E\}")), quoted(e["value"]))
        now = cut(
            now.join(ready, ["project", "path"], "left").select(
                "project",
                "path",
                F.when(F.col("inner").isNotNull(), F.aggregate(F.map_entries("inner"), F.col("text"), put)).otherwise(F.col("text")).alias("text")
            )
        )


def include_edges(files: DataFrame, extensions: list[str]) -> DataFrame:
    r"""(project, parent, target, child): what each file of a project includes, from its text (GR1, JN22).

    Targets of \input and \include outside comments are paths from the project's root; the child is the first that exists of
    the target itself and the target with each extension, or null.
    """
    from ledgerloom.functions.text import command_arguments, without_comments

    called = files.select("project", F.col("path").alias("parent"), F.explode(F.array_distinct(command_arguments(without_comments(F.col("text")), "(?:input|include)"))).alias("target"))
    wanted = called.select("project", "target").distinct()
    candidates = wanted.select("project", "target", F.posexplode(F.array("target", *[F.concat("target", F.lit(e)) for e in extensions])).alias("rank", "path"))
    hits = candidates.join(files.select("project", "path").distinct(), ["project", "path"]).groupBy("project", "target").agg(F.min_by("path", "rank").alias("child"))
    return called.join(hits, ["project", "target"], "left").select("project", "parent", "target", "child")


def discovered(files: DataFrame, roots: DataFrame, extensions: list[str]) -> DataFrame:
    """(project, path, kind, depth) of what the roots (project, path) lead to (GR1).

    Kinds: `file`, with the fewest includes between it and a root; `missing`, a target that no file stands for, as deep as
    if it were there; `cycle`, a file that includes lead from back to it, with its depth as a file.  A file that is reached
    twice is one row and no cycle (Z4).  One join a level, and one a round of the search for cycles; each is kept.
    """
    edges = cut(include_edges(files, extensions))
    there = edges.filter("child IS NOT NULL").select("project", F.col("parent").alias("path"), "child").distinct()
    level = cut(roots.join(files.select("project", "path").distinct(), ["project", "path"], "left_semi").select("project", "path", F.lit(0).alias("depth")).distinct())
    found = level
    while not level.isEmpty():
        after = level.join(there, ["project", "path"]).select("project", F.col("child").alias("path"), (F.col("depth") + 1).alias("depth")).distinct()
        level = cut(after.join(found.select("project", "path"), ["project", "path"], "left_anti"))
        found = cut(found.union(level))
    reached = edges.join(found.select("project", F.col("path").alias("parent"), "depth"), ["project", "parent"])
    missing = reached.filter("child IS NULL").groupBy("project", F.col("target").alias("path")).agg((F.min("depth") + 1).alias("depth"))
    # what is on no way back: files without an include into them, and files without one out of them, are taken off in turn
    core = cut(reached.filter("child IS NOT NULL").select("project", "parent", "child").distinct())
    size, before = core.count(), -1
    while size not in (0, before):
        inner = core.join(core.select("project", F.col("child").alias("parent")).distinct(), ["project", "parent"], "left_semi")
        core = cut(inner.join(core.select("project", F.col("parent").alias("child")).distinct(), ["project", "child"], "left_semi").select("project", "parent", "child"))
        size, before = core.count(), size
    on_cycle = _led_back(core).join(found, ["project", "path"])
    named = lambda df, kind: df.select("project", "path", F.lit(kind).alias("kind"), "depth")
    return named(found, "file").union(named(missing, "missing")).union(named(on_cycle, "cycle"))


def _led_back(core: DataFrame) -> DataFrame:
    """(project, path) of the nodes of a graph (project, parent, child) that a way leads from back to them: pairs of a node
    and what it reaches grow until none is new; the graph is what is left between cycles.
    """
    steps = core.select("project", F.col("parent").alias("via"), F.col("child").alias("to"))
    pairs = cut(core.select("project", F.col("parent").alias("path"), F.col("child").alias("to")).distinct())
    new = pairs
    while not new.isEmpty():
        further = new.select("project", "path", F.col("to").alias("via")).join(steps, ["project", "via"]).select("project", "path", "to").distinct()
        new = cut(further.join(pairs, ["project", "path", "to"], "left_anti"))
        pairs = cut(pairs.union(new))
    return pairs.filter("path = to").select("project", "path")
