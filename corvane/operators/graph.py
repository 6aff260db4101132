"""Queries over the graph of symbols and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.lineage import cut


def edges(relationships: DataFrame, level: str = "any") -> DataFrame:
    """Distinct (src, dst, kind) of a relationship table, from symbol or else file ids; incomplete edges and self-loops are left out."""
    pairs = {"symbol": ("from_id", "to_id"), "file": ("from_file_id", "to_file_id")}
    if level in pairs:
        src, dst = map(F.col, pairs[level])
    else:
        src, dst = F.coalesce("from_id", "from_file_id"), F.coalesce("to_id", "to_file_id")
    return relationships.select(src.alias("src"), dst.alias("dst"), "kind").filter("src is not null and dst is not null and src <> dst").distinct()


def resolve_edges(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst) file ids of edges given as (from_path, to_path) within a project; both ends must be known, self-loops are left out."""
    a = files.select(F.col("project_id"), F.col("path").alias("from_path"), F.col("id").alias("src"))
    b = files.select(F.col("project_id"), F.col("path").alias("to_path"), F.col("id").alias("dst"))
    return paths.join(a, ["project_id", "from_path"]).join(b, ["project_id", "to_path"]).filter("src <> dst").select("project_id", "src", "dst").distinct()


def neighbours(edge: DataFrame, symbols: DataFrame, files: DataFrame, direction: str = "callers") -> DataFrame:
    """(seed, id, name, qualified_name, kind, path, line_start): direct callers or callees of every symbol, with their place."""
    seed, other = ("dst", "src") if direction == "callers" else ("src", "dst")
    of = symbols.select("id", "name", "qualified_name", "kind", "file_id", "line_start")
    places = files.select(F.col("id").alias("file_id"), "path")
    found = edge.select(F.col(seed).alias("seed"), F.col(other).alias("id")).distinct()
    return found.join(of, "id").join(places, "file_id").select("seed", "id", "name", "qualified_name", "kind", "path", "line_start")


def expand(edge: DataFrame, seeds: DataFrame, hops: int = 3, directed: bool = False) -> DataFrame:
    """(seed, id, hop): what is within ``hops`` edges of each seed, at its least hop, without the seed itself.

    One join per hop; nodes already reached are removed by an anti-join, so
    cycles do not multiply rows. Lineage is cut each hop.
    """
    both = edge.select("src", "dst")
    if not directed:
        both = both.unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = both.distinct()
    reached = seeds.select(F.col("seed"), F.col("seed").alias("id"), F.lit(0).alias("hop")).distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.join(both, frontier.id == both.src).select("seed", F.col("dst").alias("id")).distinct()
        frontier = step.join(reached, ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop))
        if hop < hops:
            frontier = cut(frontier)
        reached = reached.unionByName(frontier)
    return reached.filter("hop > 0")


def impact(edge: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "out") -> DataFrame:
    """(seed, id, hop): what a change reaches along the edges within ``depth``; ``direction`` ``in`` follows them backwards."""
    if direction == "in":
        edge = edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return expand(edge, seeds, depth, directed=True)


def components(edge: DataFrame) -> DataFrame:
    """(id, component): nodes in a strongly connected component of two or more, and the least id of it.

    Nodes without an in- or out-edge are trimmed away until none is left; then
    every node gets the label of least priority among those that reach it, and
    within the nodes of one label those that also reach the label's node
    backwards are its component, and leave. Priorities are random and new in
    each round, so the rounds that a chain of components takes grow with the
    logarithm of its length. The driver sees only counts.
    """
    left = cut(edge.select("src", "dst").filter("src <> dst").distinct())
    found: DataFrame | None = None
    n, turn = left.count(), 0
    while n:
        trimmed = cut(_trimmed(_trimmed(_trimmed(_trimmed(left)))))
        left, before, n = trimmed, n, trimmed.count()
        if n < before or not n:
            continue
        turn += 1
        nodes = left.select(F.col("src").alias("id")).distinct()
        forward = _least(nodes.withColumn("label", F.struct(F.xxhash64(F.lit(turn), "id").alias("p"), F.col("id").alias("of"))), left)
        same = left.join(forward.toDF("src", "a"), "src").join(forward.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst")
        done = cut(_reach(forward.filter("id = label.of").select("id", F.col("label.of").alias("label")), cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))))
        found = done if found is None else found.unionByName(done)
        gone = done.select("id")
        left = cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
        n = left.count()
    if found is None:
        return nodes_none(edge)
    sizes = found.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("component")).filter("n > 1").select("label", "component")
    return found.join(sizes, "label").select("id", "component")


def _trimmed(edge: DataFrame) -> DataFrame:
    """Edges that something leads to and something leads on from."""
    on = edge.join(edge.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return on.join(edge.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def nodes_none(edge: DataFrame) -> DataFrame:
    """An empty (id, component)."""
    return edge.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)


def _least(label: DataFrame, edge: DataFrame) -> DataFrame:
    """Each node's least label among those that reach it."""
    while True:
        sent = edge.join(label.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("sent"))
        new = cut(label.join(sent, "id", "left").select("id", F.least("label", F.coalesce("sent", "label")).alias("label"), (F.col("sent") < F.col("label")).alias("moved")))
        label = new.select("id", "label")
        if new.filter("moved").isEmpty():
            return label


def _reach(start: DataFrame, edge: DataFrame) -> DataFrame:
    """What is reached from ``start`` along ``edge``, with the start's label."""
    reached = frontier = start.select("id", "label")
    while True:
        step = frontier.join(edge, frontier.id == edge.src).select(F.col("dst").alias("id"), "label").distinct()
        frontier = cut(step.join(reached, "id", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def entry_points(symbols: DataFrame, edge: DataFrame) -> DataFrame:
    """Public functions and modules that nothing points to."""
    wanted = symbols.filter((F.col("visibility") == "public") & F.col("kind").isin("function", "module"))
    return wanted.join(edge.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def module_tree(symbols: DataFrame, most: int | None = None) -> DataFrame:
    """(project_id, namespace, symbols): symbols by the first dotted part of their qualified name; the ``most`` largest per project if given."""
    grouped = symbols.filter(F.col("qualified_name").isNotNull()).groupBy("project_id", F.substring_index("qualified_name", ".", 1).alias("namespace")).agg(F.count("*").alias("symbols"))
    if most is None:
        return grouped
    order = Window.partitionBy("project_id").orderBy(F.desc("symbols"), "namespace")
    return grouped.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def find_symbol(symbols: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Symbols of a name: equal names first, then those that contain it, shortest qualified name first. ``name/2`` asks for an arity."""
    import re

    found = re.fullmatch(r"(.+)/(\d{1,9})", name)
    plain = found[1] if found else name
    exact = (F.col("qualified_name") == name) | (F.col("name") == plain) | (F.col("qualified_name") == plain)
    like = F.lower("qualified_name").contains(plain.lower()) | F.lower("name").contains(plain.lower())
    with_arity = F.col("qualified_name").endswith(f"/{found[2]}") if found else F.lit(False)
    rank = F.when(exact & with_arity, 0).when(exact, 1).otherwise(2)
    chosen = symbols.filter(exact | like).withColumn("match", rank)
    return chosen.orderBy("match", F.length("qualified_name"), "id").limit(most)


def parse_dot(lines: DataFrame) -> DataFrame:
    """(from_path, to_path) of the edges in lines (column value) of a DOT graph."""
    pattern = r'"([^"]+)"\s*->\s*"([^"]+)"'
    return lines.filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("from_path"), F.regexp_extract("value", pattern, 2).alias("to_path"))


def rebuilt(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges after an incremental rebuild: old ones that touch no changed file, and the newly extracted ones."""
    gone = changed.select("id")
    kept = old.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept.select("src", "dst", "kind").unionByName(new.select("src", "dst", "kind")).distinct()


def import_edges(sources: DataFrame, files: DataFrame, text: str = "content") -> DataFrame:
    """(project_id, src, dst) file edges of what source files (project_id, path, language, content) import.

    An import names a path of the project, or a path relative to the importing
    file (``./x``, ``../x``), with or without its extension, or a dotted name
    whose parts are the end of a path. All three are equi-joins on keys made of
    the files' paths; ambiguous names lead to every file they fit, self-loops
    are left out.
    """
    from corvane.operators.parsers import imports

    lang = F.lower(F.coalesce("language", F.lit("")))
    found = F.when(lang.isin("typescript", "tsx", "javascript"), imports(F.col(text), "typescript")).when(lang == "python", imports(F.col(text), "python")).when(lang == "elixir", imports(F.col(text), "elixir")).otherwise(imports(F.col(text), "generic"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    named = sources.select("project_id", F.col("path").alias("from_path"), folder.alias("folder"), F.explode(F.array_distinct(found)).alias("name"))
    joined = F.concat("folder", F.regexp_replace("name", r"^(\./)+", ""))
    up = lambda held, part: (part == "..") & (F.size(held) > 0) & (F.coalesce(F.get(held, F.size(held) - 1), F.lit("")) != "..")
    fold = lambda held, part: F.when(up(held, part), F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).when(part == ".", held).otherwise(F.concat(held, F.array(part)))
    joined = F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), fold), "/")  # each step up removes one folder
    wanted = F.when(F.col("name").startswith("."), joined).when(F.contains(F.col("name"), F.lit("/")), F.col("name")).otherwise(F.replace("name", F.lit("."), F.lit("/")))
    asked = named.select("project_id", "from_path", F.lower(wanted).alias("key")).distinct()
    bare = F.lower(F.regexp_replace("path", r"\.[^./]*$", ""))
    parts = F.split(bare, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))
    keys = files.select("project_id", F.col("id").alias("dst"), F.explode(F.array_distinct(F.concat(F.array(F.lower("path"), bare), ends))).alias("key"))
    origin = files.select("project_id", F.col("path").alias("from_path"), F.col("id").alias("src"))
    return asked.join(keys, ["project_id", "key"]).join(origin, ["project_id", "from_path"]).filter("src <> dst").select("project_id", "src", "dst").distinct()
