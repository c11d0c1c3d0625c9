"""Dependency graphs: closures and name resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN, normal_path
from .tables import Parts, cut, in_ranges, new_path

#: Most nodes and edges of a graph that a task reads whole; roots followed together, and nodes they reach before they are parted.
GRAPH, AT_ONCE, REACHED = 1 << 25, 2048, 1 << 21


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> node, root for every node with an edge to another; the root is the least node of its component.

    Alternating star contraction: each larger neighbour of a node is linked with the least node around it, then each
    smaller one. Minima are partial sums joined back, so no node's neighbours meet in one task; rounds grow with the
    logarithm of the longest chain, and each is written.
    """
    now, seen = cut(edges.where("u <> v").select("u", "v").distinct(), "edges"), None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _read(path: str) -> pa.Table:
    """A table of the shared folder in the order it was written in."""
    system, at = fs.FileSystem.from_uri(path)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-"))
    return pa.concat_tables(pq.read_table(name, filesystem=system) for name in names)


class _Graph:
    """The graph as numbers: ``ends`` of a node's edges lie from ``begin`` of it to that of the next."""

    def __init__(self, nodes: str, edges: str):
        self.nodes, links = _read(nodes), _read(edges)
        self.begin = np.zeros(self.nodes.num_rows + 1, np.int64)
        np.cumsum(np.bincount(links.column("s").to_numpy(), minlength=self.nodes.num_rows), out=self.begin[1:])
        self.ends = links.column("d").to_numpy()

    def after(self, nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.begin[nodes + 1] - self.begin[nodes]
        return np.repeat(at, n), self.ends[np.arange(n.sum()) + np.repeat(self.begin[nodes] - np.cumsum(n) + n, n)]

    def reach(self, roots: np.ndarray, deepest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For parts of the roots: places in ``roots``, nodes reached and depths. Roots that reach much go fewer at once, and one alone marks the nodes it has seen."""
        parts = [np.arange(len(roots))]
        while parts:
            some = parts.pop()
            n, seen = self.nodes.num_rows, None
            new = some * n + roots[some].astype(np.int64)
            found, total = [new], len(new)
            for _ in range(deepest):
                at, node = self.after(new % n, new // n)
                if len(some) > 1 and total + len(node) > REACHED:
                    parts += [some[len(some) // 2:], some[:len(some) // 2]]
                    break
                step = at * n + node
                if len(some) > 1:
                    step = np.unique(step)
                    seen = found[0] if seen is None else np.sort(np.concatenate([seen, new]), kind="stable")
                    new = step[seen[np.minimum(np.searchsorted(seen, step), len(seen) - 1)] != step]
                else:
                    if seen is None:
                        seen = np.zeros(n, bool)
                    seen[new % n] = True
                    new = np.unique(step[~seen[node]])
                if not len(new):
                    yield self._parts(found, n)
                    break
                found.append(new)
                total += len(new)
            else:
                yield self._parts(found, n)

    def _parts(self, found: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.concatenate(found)
        return key // n, key % n, np.repeat(np.arange(len(found)), [len(x) for x in found])


_held: dict[tuple[str, str], _Graph] = {}


def _graph(nodes: str, edges: str) -> _Graph:
    """A worker reads a graph once and holds no other."""
    if (nodes, edges) not in _held:
        _held.clear()
        _held[nodes, edges] = _Graph(nodes, edges)
    return _held[nodes, edges]


class Reach:
    """What roots reach over edges(src, dst); with local(node) only edges from local nodes are followed.

    Nodes are numbered and the graph is written once. Each task reads it whole, as numbers, and follows its own roots: what
    is reached is neither shuffled nor compared with a table. A graph of more than ``GRAPH`` nodes and edges, or in a folder
    that only Spark can open, is closed in rounds of joins.
    """

    def __init__(self, edges: DataFrame, roots: DataFrame, local: DataFrame | None = None, deepest: int = 10_000):
        spark = roots.sparkSession
        self.edges, self.roots, self.local, self.deepest, self.graph = edges.select("src", "dst"), roots.select("root").distinct(), local, deepest, None
        known = local.select("node", F.lit(True).alias("found")).distinct() if local is not None else None
        every = [self.edges.select(F.col("src").alias("node")), self.edges.select(F.col("dst").alias("node")), self.roots.select(F.col("root").alias("node"))]
        nodes = every[0].unionAll(every[1]).unionAll(every[2]).distinct()
        nodes = nodes.join(known.hint("merge"), "node", "left").withColumn("found", F.coalesce("found", F.lit(False))) if local is not None else nodes.withColumn("found", F.lit(True))
        by, ranges = in_ranges(nodes, "node")
        n = F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1 + F.col("before")
        paths = new_path(spark, "nodes"), new_path(spark, "links")
        by.join(F.broadcast(ranges.select("part", "before")), "part").select(n.cast("long").alias("n"), "node", "found").repartitionByRange("n").sortWithinPartitions("n").write.parquet(paths[0])
        self.nodes = spark.read.parquet(paths[0])
        s, d = (self.nodes.select(F.col("node").alias(f"{c}_node"), F.col("n").cast("int").alias(c), F.col("found").alias(f"{c}_found")) for c in "sd")
        links = self.edges.join(s.hint("merge"), F.col("src").eqNullSafe(F.col("s_node"))).where("s_found" if local is not None else "src IS NOT NULL")
        links = links.select("s", "dst").join(d.hint("merge"), F.col("dst").eqNullSafe(F.col("d_node"))).select("s", "d").distinct()
        links.repartitionByRange("s").sortWithinPartitions("s").write.parquet(paths[1])
        try:
            fs.FileSystem.from_uri(paths[0])
        except (pa.ArrowException, OSError, ValueError):
            return
        if self.nodes.count() + spark.read.parquet(paths[1]).count() <= GRAPH:
            self.graph = paths

    def _numbered(self, rows: DataFrame, column: str, number: str) -> DataFrame:
        n = self.nodes.select(F.col("node").alias("__node"), F.col("n").alias(number))
        return rows.join(n.hint("merge"), F.col(column).eqNullSafe(F.col("__node"))).drop("__node")

    def all(self) -> DataFrame:
        """root, node, depth, found: whether the node is local."""
        if not self.graph:
            inner = self.edges if self.local is None else self.edges.join(self.local.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
            reached = _rounds(inner, self.roots, self.deepest)
            found = self.nodes.select("node", "found")
            return reached.join(found, "node").select("root", "node", "depth", "found")
        graph, deepest = self.graph, self.deepest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                roots, g = batch.column("r").to_numpy(), _graph(*graph)
                name, found = g.nodes.column("node"), g.nodes.column("found")
                for to in range(0, len(roots), AT_ONCE):
                    few = roots[to:to + AT_ONCE]
                    for at, node, depth in g.reach(few, deepest):
                        for i in range(0, len(at), 100_000):
                            own, other = pa.array(few[at[i:i + 100_000]]), pa.array(node[i:i + 100_000])
                            yield from pa.table({"root": name.take(own), "node": name.take(other), "depth": depth[i:i + 100_000], "found": found.take(other)}).combine_chunks().to_batches()

        numbered = self._numbered(self.roots, "root", "r").select("r")
        kind = self.roots.schema["root"].dataType
        out = T.StructType([T.StructField("root", kind), T.StructField("node", kind), T.StructField("depth", T.LongType()), T.StructField("found", T.BooleanType())])
        tasks = self.roots.sparkSession.sparkContext.defaultParallelism * 4
        return numbered.repartition(tasks).mapInArrow(run, out)

    def within(self, pairs: DataFrame, root: str, node: str) -> DataFrame:
        """The pairs of a root and a local node it reaches."""
        if not self.graph:
            reached = self.all().where("found").select(F.col("root").alias(root), F.col("node").alias(node))
            return pairs.select(root, node).distinct().join(reached, [root, node], "left_semi")
        graph, deepest = self.graph, self.deepest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g = _graph(*graph)
                r, v = batch.column("r").to_numpy(), batch.column("v").to_numpy()
                roots, of = np.unique(r, return_inverse=True)
                own, asked = g.nodes.column("found").take(pa.array(v)).to_numpy(), of * g.nodes.num_rows + v
                inside = np.zeros(len(r), bool)
                for to in range(0, len(roots), AT_ONCE):
                    for at, reached, _ in g.reach(roots[to:to + AT_ONCE], deepest):
                        inside |= np.isin(asked, (at + to) * g.nodes.num_rows + reached)
                yield batch.filter(pa.array(inside & own))

        asked = self._numbered(self._numbered(pairs.select(root, node).distinct(), root, "r"), node, "v")
        return asked.repartition("r").sortWithinPartitions("r").mapInArrow(run, asked.schema).select(root, node)


def _rounds(edges: DataFrame, roots: DataFrame, most_rounds: int) -> DataFrame:
    """root, node, depth. Each round expands the last frontier of all roots together and is written as a part of one table,
    which the next round reads for what it has seen; nothing is written twice. Rounds are as many as the longest path."""
    table = Parts(roots.sparkSession, "closure")
    frontier = table.add(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth")).distinct())
    links = edges.select(F.col("src").alias("node"), "dst").distinct()
    for depth in range(1, most_rounds + 1):
        step = frontier.select("root", "node").join(links, "node").select("root", F.col("dst").alias("node")).distinct()
        new = step.join(table.all().select("root", "node"), ["root", "node"], "left_anti")
        frontier = table.add(new.withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
    return table.all()


def closure(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """edges(src, dst), roots(root) -> root, node, depth of everything reachable, cycles closed once."""
    return Reach(edges, roots, deepest=most_rounds).all().select("root", "node", "depth")


def local_closure(edges: DataFrame, roots: DataFrame, local: DataFrame) -> DataFrame:
    """edges(src, dst), roots(root), local(node) -> root, node, found: modules reached, and with ``found`` false those outside, which are not followed."""
    return Reach(edges, roots, local).all().select("root", "node", "found")


def compiler_closure(declarations: DataFrame, uses: DataFrame, targets: DataFrame) -> DataFrame:
    """declarations(name, local, kind), uses(name, dependency), targets(entry, name) -> entry, name, state.

    Local declarations are followed; an ``external`` one is recorded, a name without a declaration is ``missing``. A ``sorry``
    and an ``axiom`` are told from ``resolved`` by name and kind, whether local or not.
    """
    local = declarations.where("local").select(F.col("name").alias("src")).distinct()
    entry, name = lambda c: F.concat(F.lit("entry "), F.col(c).cast("string")), lambda c: F.concat(F.lit("name "), F.col(c))
    inner = uses.select(F.col("name").alias("src"), F.col("dependency").alias("dst")).join(local, "src", "left_semi").select(name("src").alias("src"), name("dst").alias("dst"))
    edges = inner.unionAll(targets.select(entry("entry").alias("src"), name("name").alias("dst")))
    reached = closure(edges, targets.select(entry("entry").alias("root")).distinct()).where("depth > 0").select(F.substring("root", 7, 1 << 30).alias("entry"), F.substring("node", 6, 1 << 30).alias("name"))
    d = declarations.groupBy("name").agg(F.max("local").alias("local"), F.min("kind").alias("kind"))
    state = (F.when(F.col("name").isin("sorry", "sorryAx"), "sorry").when(F.col("kind") == "axiom", "axiom").when(F.col("local").isNull(), "missing")
             .when(F.col("local"), "resolved").otherwise("external"))
    return reached.join(d, "name", "left").select("entry", "name", state.alias("state"))


def cite_reach(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files(path, inputs), roots(directory, path) -> directory, path of every TeX file reached.

    A name is looked up beside the root file first, then beside the file that names it; so the root's folder goes along with
    each file reached. A name found in neither place is passed over.
    """
    folder = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))
    beside = lambda at, name: normal_path(F.concat(at, F.lit("/"), name))
    known = files.select("path").distinct()
    named = files.select("path", F.explode("inputs").alias("name")).distinct()
    table, state = Parts(files.sparkSession, "reach"), ["directory", "base", "path"]
    frontier = table.add(roots.join(known, "path", "left_semi").select("directory", folder(F.col("path")).alias("base"), "path").distinct())
    while not frontier.isEmpty():
        places = F.array(beside(F.col("base"), F.col("name")), beside(folder(F.col("path")), F.col("name")))
        asked = frontier.join(named, "path").select(*state, "name", F.posexplode(places).alias("nth", "to"))
        there = asked.join(known.withColumnRenamed("path", "to"), "to", "left_semi").groupBy(*state, "name").agg(F.min_by("to", "nth").alias("to"))
        child = there.select("directory", "base", F.col("to").alias("path")).distinct()
        frontier = table.add(child.join(table.all(), state, "left_anti"))
    return table.all().select("directory", "path").distinct()


def suffixes(name: Column) -> Column:
    """All dotted suffixes, the whole name first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def two_hops(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds(node) -> node, depth within two references (G7); two joins, no loop."""
    e = edges.select("src", "dst").distinct()
    zero = seeds.select("node", F.lit(0).cast("long").alias("depth"))
    one = zero.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(1).cast("long").alias("depth"))
    two = one.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(2).cast("long").alias("depth"))
    return zero.unionAll(one).unionAll(two).groupBy("node").agg(F.min("depth").alias("depth"))


def name_index(declarations: DataFrame) -> DataFrame:
    """declarations(key, name, module) -> token, in_module, n, key: how many names of a module end in a token, and the least."""
    each = declarations.select("key", F.col("module").alias("in_module"), F.explode(suffixes(F.col("name"))).alias("token")).distinct()
    return each.groupBy("token", "in_module").agg(F.count("*").alias("n"), F.min("key").alias("key"))


def _large(table: DataFrame) -> DataFrame:
    """Joined by sorting: a written table of names is small in its files and large in memory, so its size must not let it be sent through the driver."""
    return table.hint("merge")


def chosen(asked: DataFrame, index: DataFrame, reachable: DataFrame | Reach) -> DataFrame:
    """asked(entry, module, token), reachable(entry, in_module) -> the same with key and known (J9, A12). A ``Reach`` is asked for the pairs that matter only.

    A token is the one declaration of its own module that it ends, else the one in all modules its entry reaches, else none;
    ``known`` tells whether it ends any name at all.
    """
    own = ["entry", "module", "token"]
    asked = asked.select(*own).distinct()
    sought = asked.withColumn("sought", F.replace("token", F.lit("_root_."), F.lit("")))
    hits = sought.join(_large(index.withColumnRenamed("token", "sought")), "sought")
    if isinstance(reachable, Reach):
        hits = cut(hits, "hits")
        reachable = reachable.within(hits, "entry", "in_module")
    scope = reachable.select("entry", "in_module").distinct().withColumn("in_scope", F.lit(True))
    hits = hits.join(_large(scope), ["entry", "in_module"], "left")
    here, far = F.col("in_module") == F.col("module"), F.coalesce("in_scope", F.lit(False))
    total = lambda w: F.sum(F.when(w, F.col("n")))
    found = hits.groupBy(*own).agg(total(here).alias("a"), F.min(F.when(here, F.col("key"))).alias("ka"), total(far).alias("b"), F.min(F.when(far, F.col("key"))).alias("kb"))
    found = found.select(*own, F.when(F.col("a") == 1, F.col("ka")).when(F.col("b") == 1, F.col("kb")).alias("key"))
    known = asked.join(_large(index.select("token").distinct()), "token", "left_semi").withColumn("known", F.lit(True))
    return asked.join(_large(found), own, "left").join(_large(known), own, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def seeds(entries: DataFrame, targets: DataFrame, declarations: DataFrame, reachable: DataFrame | Reach) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries(entry, module, text), targets(entry, target) -> seeds(entry, key), unresolved(entry, target), fallback declarations.

    An entry none of whose targets is found is its own text, kept as a declaration with the key ``module:entry``.
    """
    asked = targets.join(_large(entries.select("entry", "module")), "entry").select("entry", "module", F.col("target").alias("token"))
    told = cut(chosen(asked, name_index(declarations), reachable))
    found = told.where("key IS NOT NULL").select("entry", "key").distinct()
    bare = entries.join(_large(found.select("entry").distinct()), "entry", "left_anti")
    key = F.concat("module", F.lit(":entry"))
    fallback = bare.select(key.alias("key"), F.col("module").alias("name"), "module", F.lit(1).cast("long").alias("line"), "text")
    return found.unionAll(bare.select("entry", key.alias("key"))), told.where("key IS NULL").select("entry", F.col("token").alias("target")), fallback


def expand(declarations: DataFrame, start: DataFrame, reachable: DataFrame | Reach, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """declarations(key, name, module, text), start(entry, key) -> included(entry, key, depth), ambiguous(entry, token).

    Names in a text are its references, but for its own and undotted ones under eight letters; each hop resolves those of the
    last. A dotted name that ends several declarations and is none of one is ambiguous.
    """
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("token")
    tokens = declarations.select("key", "name", "module", names).where((F.col("token") != F.col("name")) & (F.col("token").contains(".") | (F.length("token") >= 8)))
    tokens, index = cut(tokens.select("key", "module", "token")), cut(name_index(declarations))
    table, unclear = Parts(declarations.sparkSession, "expand"), Parts(declarations.sparkSession, "unclear")
    frontier = table.add(start.select("entry", "key", F.lit(0).cast("long").alias("depth")).distinct())
    for depth in range(1, hops + 1):
        told = cut(chosen(frontier.join(_large(tokens), "key"), index, reachable))
        unclear.add(told.where("key IS NULL AND known AND token LIKE '%.%'").select("entry", "token"))
        new = told.where("key IS NOT NULL").select("entry", "key").distinct().join(_large(table.all()), ["entry", "key"], "left_anti")
        frontier = table.add(new.withColumn("depth", F.lit(depth).cast("long")))
    return table.all(), unclear.all().distinct()


def owners(names: DataFrame) -> DataFrame:
    """names(name, in_module, has_range) -> each name's owner: itself, else the nearest dotted ancestor of its module with a range."""
    parts = F.split("name", r"\.")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))
    ranged = names.where("has_range").select(F.col("name").alias("owner"), F.col("in_module").alias("o_module"))
    found = names.select("name", "in_module", up.alias("owner_at")).join(ranged, (F.col("owner_at") == F.col("owner")) & (F.col("in_module") == F.col("o_module")))
    best = found.groupBy("name", "in_module").agg(F.max_by("owner", F.length("owner")).alias("owner"))
    return names.select("name", "in_module").join(best, ["name", "in_module"], "left")
