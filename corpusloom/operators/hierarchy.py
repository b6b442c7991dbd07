"""Parent-child rows as full hierarchies: cycles, Euler tours, depth, root, path and descendants.

Edges are (parent, child) pairs of string keys. Nothing here walks level by level: peeling, list ranking and paths all
follow pointers that double in length, so a chain of depth d takes log2(d) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.paths import resolve
from corpusloom.runtime import cut

FAN_OUT = 4096  # children of one parent that are put in order within one task


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """(parent, child) of chunks whose parent exists; keys are 'chunks:<id>'. A dangling parent makes its chunk a root."""
    key = lambda c: F.concat(F.lit("chunks:"), F.col(c).cast("string"))
    rows = chunks.where("id is not null and parent_chunk_id is not null").select(key("id").alias("child"), key("parent_chunk_id").alias("parent")).distinct()
    return rows.join(chunks.select(key("id").alias("parent")).distinct(), "parent", "left_semi").select("parent", "child")


def folder_edges(folders: DataFrame) -> DataFrame:
    """(parent, child) from folders.children, keys 'folders:<path>'; children without a row are left out.

    An entry without a slash is appended to the folder's path, one with a slash starts at the collection root.
    Null, empty and repeated entries count once or not at all.
    """
    clean = lambda c: F.substring(resolve(F.concat(F.lit("/"), c)), 2, 1 << 30)
    rows = folders.select("collection_id", clean(F.col("path")).alias("at"), F.col("path"), F.explode("children").alias("entry")).where("entry is not null and entry <> ''")
    rooted = F.translate("entry", "\\", "/").contains("/")
    rows = rows.withColumn("target", clean(F.when(rooted, F.col("entry")).otherwise(F.concat("at", F.lit("/"), "entry"))))
    there = folders.select("collection_id", clean(F.col("path")).alias("target"), F.col("path").alias("child_path")).distinct()
    key = lambda c: F.concat(F.lit("folders:"), F.col(c))
    return rows.join(there, ["collection_id", "target"]).select(key("path").alias("parent"), key("child_path").alias("child")).distinct()


def peel(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Peel leaves: (nodes left, pointer tables). edges: one parent per child.

    Peeling 2^k times leaves the nodes that have a descendant 2^k steps below, which are the targets of pointers of
    length 2^k. Heights below a finite height are consecutive, so once a round peels nothing, all that is left
    lies on cycles. pointers[k] holds (node, up) with up 2^k steps above node.
    """
    jump = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("up")))
    tables, left = [jump], -1
    while True:
        core = jump.select(F.col("up").alias("node")).distinct()
        n = core.count()
        if n in (0, left):
            return core, tables
        left = n
        jump = cut(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up")))
        tables.append(jump)


def _looped(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of a digraph that reach themselves, by forward colours and backward closure.

    Each pass takes nodes without in- or out-edges off, spreads the largest key forward to a fixpoint and keeps, of each
    colour, the nodes from which its root is reached. It is run on junctions only.
    """
    out, rest = None, cut(edges)
    while True:
        n = -1
        while n != (n := rest.count()):  # peel both ends
            rest = cut(rest.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(rest.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        if n == 0:
            return out
        colour, seen = cut(rest.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v"))), None
        while True:
            pushed = rest.join(colour, F.col("a") == F.col("v")).select(F.col("b").alias("v"), "c").unionByName(colour)
            colour = cut(pushed.groupBy("v").agg(F.max("c").alias("c")))
            total = colour.agg(F.sum(F.xxhash64("v", "c").cast("decimal(38,0)"))).first()[0]
            if total == seen:
                break
            seen = total
        same = cut(rest.join(colour.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c")))
        back, n = cut(colour.where("v = c").select("v", "c")), -1
        while n != (n := back.count()):
            back = cut(back.unionByName(same.join(back.select(F.col("v").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("v"), "c")).distinct())
        inner = same.join(back.select(F.col("v").alias("a"), "c"), ["a", "c"], "left_semi").join(back.select(F.col("v").alias("b"), "c"), ["b", "c"], "left_semi")
        loops = inner.select("c").distinct()
        found = back.join(loops, "c", "left_semi").select(F.col("v").alias("node"), F.col("c").alias("comp"))
        out = cut(found if out is None else out.unionByName(found))
        done = back.select("v")
        rest = cut(rest.join(done.select(F.col("v").alias("a")), "a", "left_anti").join(done.select(F.col("v").alias("b")), "b", "left_anti"))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """node: the nodes of (parent, child) that reach themselves, in any digraph.

    Children with one parent form a forest plus pure cycles, which peeling exposes. Children with several parents are
    junctions: the forest is cut above them, each edge into a junction becomes an edge between the tops of
    the trees, loops among those few are found, and what lies on the way back down is marked.
    """
    edges = cut(edges.where("parent is not null and child is not null").select("parent", "child").distinct())
    junctions = cut(edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select(F.col("child").alias("node")))
    forest = edges.join(junctions.select(F.col("node").alias("child")), "child", "left_anti")
    core, tables = peel(forest)
    into = edges.join(junctions.select(F.col("node").alias("child")), "child", "left_semi")
    if into.isEmpty():
        return core
    # the tree top above each end of an edge into a junction: long jumps first
    ends = into.select(F.col("parent").alias("end"), "child").withColumn("top", F.col("end"))
    for jump in reversed(tables):
        ends = ends.join(jump.select(F.col("node").alias("top"), "up"), "top", "left").select("end", "child", F.coalesce("up", "top").alias("top"))
    ends = cut(ends.join(junctions.select(F.col("node").alias("top")), "top", "left_semi"))
    comps = _looped(ends.select(F.col("top").alias("a"), F.col("child").alias("b")).distinct())
    if comps is None:
        return core
    comp = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))
    closing = ends.join(comp("top"), "top").join(comp("child"), "child").where("top_comp = child_comp").select(F.col("end").alias("node")).distinct()
    marked = cut(closing)
    for jump in reversed(tables):  # all ancestors up to the top, for every sum of jump lengths
        marked = cut(marked.unionByName(jump.join(marked, "node", "left_semi").select(F.col("up").alias("node"))).distinct())
    return core.unionByName(marked).distinct()


def _siblings(tree: DataFrame) -> DataFrame:
    """(node, parent, next): the following sibling; the order is by key within buckets of at most about FAN_OUT children."""
    fan = tree.groupBy("parent").agg(F.count("*").alias("n"))
    rows = tree.join(fan, "parent").withColumn("bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / FAN_OUT).cast("long")))
    inside = rows.withColumn("next", F.lead("node").over(Window.partitionBy("parent", "bucket").orderBy("node")))
    heads = rows.groupBy("parent", "bucket").agg(F.min("node").alias("head"))
    heads = heads.withColumn("head_of_next", F.lead("head").over(Window.partitionBy("parent").orderBy("bucket"))).drop("head")
    return inside.join(heads, ["parent", "bucket"]).select("node", "parent", F.coalesce("next", "head_of_next").alias("next"))


def euler_tours(tree: DataFrame) -> DataFrame:
    """(node, root, depth, entry, exit) for a forest (parent, node), by list ranking of its Euler tours.

    Every node is two arcs, down and up. Each arc points at the next one of its tour; pointers double until all have reached
    the end, adding up steps and signed steps on the way. A subtree is the interval entry..exit of its node's tour.
    """
    kids = cut(_siblings(tree))
    first = kids.join(kids.select(F.col("next").alias("node")).where("node is not null"), "node", "left_anti").select(F.col("parent").alias("node"), F.col("node").alias("first"))
    nodes = kids.select("node", "parent", "next").unionByName(kids.select(F.col("parent").alias("node")).distinct().join(kids.select("node"), "node", "left_anti").withColumn("parent", F.lit(None).cast("string")).withColumn("next", F.lit(None).cast("string")))
    nodes = nodes.join(first, "node", "left")
    arc = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    down = nodes.select(arc("<", "node").alias("arc"), F.coalesce(arc("<", "first"), arc(">", "node")).alias("to"))
    up = nodes.select(arc(">", "node").alias("arc"), F.coalesce(arc("<", "next"), arc(">", "parent")).alias("to"))
    sign = F.when(F.col("to").startswith("<"), 1).otherwise(-1)
    arcs = cut(down.unionByName(up).select("arc", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.when(F.col("to").isNull(), 0).otherwise(sign).cast("long").alias("rise")))
    columns = ["arc", "last", "steps", "rise"]
    done = arcs.where("to is null").withColumn("last", F.col("arc")).select(columns)
    open_arcs = arcs.where("to is not null")
    # the targets of open arcs all differ, and arcs that have reached their end leave, so no key gathers a tree
    while not open_arcs.isEmpty():
        ahead = open_arcs.select(F.col("arc").alias("to"), F.col("to").alias("to2"), F.lit(None).cast("string").alias("last"), F.col("steps").alias("steps2"), F.col("rise").alias("rise2"))
        ahead = ahead.unionByName(done.select(F.col("arc").alias("to"), F.lit(None).cast("string").alias("to2"), "last", F.col("steps").alias("steps2"), F.col("rise").alias("rise2")))
        moved = cut(open_arcs.join(ahead, "to").select("arc", "to2", "last", (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("rise") + F.col("rise2")).alias("rise")))
        done = done.unionByName(moved.where("last is not null").select(columns))
        open_arcs = moved.where("last is null").select("arc", F.col("to2").alias("to"), "steps", "rise")
    rank, last = done, F.col("last")
    ranked = rank.select(F.substring("arc", 2, 1 << 30).alias("node"), F.col("arc").startswith("<").alias("is_down"), F.substring(last, 2, 1 << 30).alias("root"), "steps", "rise")
    both = ranked.groupBy("node", "root").agg(F.max(F.when(F.col("is_down"), F.col("steps"))).alias("from_entry"), F.max(F.when(~F.col("is_down"), F.col("steps"))).alias("from_exit"), F.max(F.when(F.col("is_down"), -F.col("rise") - 1)).alias("depth"))
    length = both.where("node = root").select("root", F.col("from_entry").alias("length"))
    return both.join(length, "root").select("node", "root", F.col("depth").cast("int").alias("depth"), (F.col("length") - F.col("from_entry")).alias("entry"), (F.col("length") - F.col("from_exit")).alias("exit"))


def tree_paths(tree: DataFrame, separator: str = " > ") -> DataFrame:
    """(node, path) from the root down for a forest (parent, node); roots are not listed. Strings and pointers double.

    A row knows whether its pointer is at a root and then leaves the joins, so the root of a large tree is no hot key.
    """
    inner = tree.select(F.col("node").alias("parent"), F.lit(True).alias("inner")).distinct()
    state = cut(tree.join(inner, "parent", "left").select("node", F.col("parent").alias("up"), F.concat("parent", F.lit(separator), "node").alias("path"), F.coalesce("inner", F.lit(False)).alias("open")))
    done = state.where("not open").select("node", "path")
    todo = state.where("open")
    while not todo.isEmpty():
        above = todo.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("open").alias("open2"))
        above = above.unionByName(done.select(F.col("node").alias("up"), F.lit(None).cast("string").alias("up2"), F.col("path").alias("path2"), F.lit(False).alias("open2")))
        tail = F.substring(F.col("path"), F.length("up") + 1, F.lit(1 << 30))
        moved = cut(todo.join(above, "up").select("node", F.col("up2").alias("up"), F.concat("path2", tail).alias("path"), F.col("open2").alias("open")))
        done = done.unionByName(moved.where("not open").select("node", "path"))
        todo = moved.where("open")
    return done


def further_descendants(tree: DataFrame, extra: DataFrame) -> DataFrame:
    """(node, top): nodes `top` from which a node reaches further subtrees over the edges (parent, child) that are not in the tree (parent, node).

    Every node above or at the parent of such an edge reaches its child, and from there what the child's subtree reaches; pairs close by doubling.
    They are few: a pair for each of the extra edges and node above it.
    """
    _, tables = peel(tree.select("parent", F.col("node").alias("child")))
    above = cut(extra.select(F.col("parent").alias("node"), "parent").distinct())
    for jump in reversed(tables):
        above = cut(above.unionByName(jump.join(above, "node").select(F.col("up").alias("node"), "parent")).distinct())
    pairs, n = cut(above.join(extra, "parent").select("node", F.col("child").alias("top")).distinct()), -1
    while n != (n := pairs.count()):
        pairs = cut(pairs.unionByName(pairs.join(pairs.select(F.col("node").alias("top"), F.col("top").alias("beyond")), "top").select("node", F.col("beyond").alias("top"))).distinct())
    return pairs


def _counted(tours: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, reached): how many different nodes each node of the pairs reaches, itself left out. Subtrees nest or are apart, so the largest ones add up."""
    place = lambda name: tours.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"), F.col("entry").alias(f"{name}_entry"), F.col("exit").alias(f"{name}_exit"))
    sets = pairs.select("node", "top").unionByName(pairs.select("node", F.col("node").alias("top"))).distinct()
    placed = sets.join(place("top"), "top", "left").select("node", "top", F.coalesce("top_root", "top").alias("root"), F.coalesce("top_entry", F.lit(0)).alias("entry"), F.coalesce("top_exit", F.lit(1)).alias("exit"))
    # within a tree an interval counts unless one that began before it ends after it
    w = Window.partitionBy("node", "root").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    outer = placed.withColumn("covered", F.coalesce(F.max("exit").over(w) > F.col("exit"), F.lit(False))).where("not covered")
    return outer.groupBy("node").agg((F.sum((F.col("exit") - F.col("entry") + 1) / 2) - 1).cast("long").alias("reached"))


def hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its place: (node, parent, root, depth, entry, exit, n_descendants, path, in_cycle, n_parents, further_tops).

    nodes: (node); edges: (parent, child). A node on a cycle has in_cycle and no place. A child of a cycle node starts a tree
    of its own. Of several parents the smallest key is the parent in the tree; n_parents tells their number. n_descendants counts all
    nodes that are reached over any parent, itself left out, of cycle nodes too; those in the tree are the nodes of its root whose entry lies between its
    entry and exit, further_tops are the other nodes whose subtrees it reaches. Nodes without edges are trees of one. Repeated rows count once;
    empty input gives no rows.
    """
    edges = cut(edges.where("parent is not null and child is not null").select("parent", "child").distinct())
    loops = cut(cycle_nodes(edges).select("node"))
    tree = edges.join(loops.select(F.col("node").alias("child")), "child", "left_anti").join(loops.select(F.col("node").alias("parent")), "parent", "left_anti")
    tree = cut(tree.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent")))
    tours, paths = cut(euler_tours(tree)), tree_paths(tree)
    extra = cut(edges.join(tree.select("parent", F.col("node").alias("child")), ["parent", "child"], "left_anti"))
    pairs = further_descendants(tree, extra)
    further = _counted(tours, pairs).join(pairs.where("node <> top").groupBy("node").agg(F.array_sort(F.collect_list("top")).alias("further_tops")), "node", "left")
    n_parents = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("n_parents"))
    out = nodes.select("node").where("node is not null").distinct().join(further, "node", "left").join(tree, "node", "left").join(tours, "node", "left").join(paths, "node", "left").join(n_parents, "node", "left").join(loops.withColumn("in_cycle", F.lit(True)), "node", "left")
    free = F.col("in_cycle").isNull()
    alone = free & F.col("root").isNull()
    return out.select(
        "node",
        "parent",
        F.when(alone, F.col("node")).otherwise(F.col("root")).alias("root"),
        F.when(alone, 0).otherwise(F.col("depth")).alias("depth"),
        F.when(alone, 0).otherwise(F.col("entry")).alias("entry"),
        F.when(alone, 1).otherwise(F.col("exit")).alias("exit"),
        F.coalesce("reached", F.when(alone, 0).otherwise(((F.col("exit") - F.col("entry") - 1) / 2).cast("long"))).alias("n_descendants"),
        F.when(free, F.coalesce("path", "node")).alias("path"),
        (~free).alias("in_cycle"),
        F.coalesce("n_parents", F.lit(0)).cast("int").alias("n_parents"),
        F.coalesce("further_tops", F.array().cast("array<string>")).alias("further_tops"),
    )
