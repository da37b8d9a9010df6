"""Bounded graph traversal and fixpoints over a table of edges (src, dst).

Work follows the frontier, not the graph, and paths are never enumerated.  A
bounded traversal is one chain of a join and an aggregate for each hop: each
row carries itself along, so no hop is computed twice, and the edges' exchange is
the same for all hops.  Fixpoints write each round's frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved


def reach(edges: DataFrame, seeds: DataFrame, depth: int, through: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): the least number of hops from each root, seeds (root, node) left out.

    Where `through` (node) is given, only its nodes pass a traversal on; others are reached but not left.
    """
    step = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    passing = step.join(through.select(F.col("node").alias("__src")), "__src", "left_semi") if through is not None else step
    seen = seeds.select("root", "node", F.lit(0).alias("depth"))
    for hop in range(1, depth + 1):
        # the frontier's rows meet the edges; every row also stands for itself
        met = seen.join(step if hop == 1 else passing, (F.col("node") == F.col("__src")) & (F.col("depth") == hop - 1), "left")
        both = F.array(F.struct("node", "depth"), F.struct(F.col("__dst").alias("node"), F.lit(hop).alias("depth")))
        rows = met.select("root", F.explode(both).alias("r")).select("root", "r.node", "r.depth").where("node IS NOT NULL")
        seen = rows.groupBy("root", "node").agg(F.min("depth").alias("depth"))
    return seen.where("depth > 0")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reverse(edges)).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, most: int) -> DataFrame:
    """(root, node, depth, truncated, n_links): the first `most` nodes within `depth` hops either way, the root among them,
    nearest first; truncated tells that there were more, n_links counts a node's edges to nodes of the same root."""
    found = reach(both_ways(edges), seeds, depth).unionByName(seeds.select("root", "node", F.lit(0).alias("depth")))
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "node"))
    cut = found.withColumns({"place": place, "n": F.count("*").over(Window.partitionBy("root"))}).where(F.col("place") <= most)
    cut = saved(cut.select("root", "node", "depth", (F.col("n") > most).alias("truncated")), "neighbourhood")
    ends = cut.join(edges, F.col("node") == F.col("src")).select("root", "node", "dst")
    inside = ends.join(cut.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_semi")
    links = inside.groupBy("root", "node").agg(F.count("*").alias("n_links"))
    return cut.join(links, ["root", "node"], "left").select("root", "node", "depth", "truncated", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def spread(edges: DataFrame, start: DataFrame, carry: list[str], stop: DataFrame | None = None, on: list[str] | None = None, hops: int = 6) -> DataFrame:
    """The least set that holds `start` (carry, node) and, with a row, the row of each node that an edge leads to from it.

    Rows of `stop`, which has the columns `on`, are not entered.  `hops` steps are one job, in which only what the frontier
    leads to moves; then its new rows are written and those of the last step are the next frontier.
    """
    step = saved(edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst")), "edges")
    columns = [*carry, "node"]
    frontier = saved(start.select(columns).distinct(), "frontier")
    have = frontier
    while True:
        seen = frontier.withColumn("hop", F.lit(0))
        for hop in range(1, hops + 1):
            met = seen.join(step, (F.col("node") == F.col("__src")) & (F.col("hop") == hop - 1), "left")
            both = F.array(F.struct("node", "hop"), F.struct(F.col("__dst").alias("node"), F.lit(hop).alias("hop")))
            rows = met.select(*carry, F.explode(both).alias("r")).select(*carry, "r.node", "r.hop").where("node IS NOT NULL")
            seen = rows.groupBy(columns).agg(F.min("hop").alias("hop"))
            if stop is not None:
                known = stop.select(*(F.col(c).alias(f"__{c}") for c in on), F.lit(True).alias("__stop"))
                same = F.col("hop") == hop
                for c in on:
                    same = same & (F.col(c) == F.col(f"__{c}"))
                seen = seen.join(known, same, "left").where("__stop IS NULL").select(*columns, "hop")
        new = saved(seen.where("hop > 0").join(have, columns, "left_anti"), "reached")
        have = have.unionByName(new.select(columns))
        frontier = new.where(F.col("hop") == hops).select(columns)
        if frontier.isEmpty():
            return have


#: Bits of a mask in one number.
WORD = 62


def inherited(edges: DataFrame, declared: DataFrame, hops: int = 6) -> DataFrame:
    """(symbol_id, effect, via): effects that a symbol's callees declare or inherit, without its own ones.

    The least fixpoint.  Effects are the few categories of a catalogue: each symbol carries a mask of them, a bit for each,
    and a hop ORs the masks of the callees that changed into their callers'.  `hops` of them are one job, after which the
    masks are written, one row for each symbol however deep the graph.  `via` is the least direct callee that brings the effect.
    """
    spark = edges.sparkSession
    kinds = sorted(r[0] for r in declared.select("effect").where("effect IS NOT NULL").distinct().collect())  # the catalogue
    if not kinds:
        return declared.select("symbol_id", "effect", F.col("symbol_id").alias("via")).limit(0)
    words = [f"m{i}" for i in range(-(-len(kinds) // WORD))]
    table = spark.createDataFrame([(k, *(1 << i % WORD if i // WORD == w else 0 for w in range(len(words)))) for i, k in enumerate(kinds)], ["effect", *words])
    step = saved(edges.select(F.col("dst").alias("__dst"), F.col("src").alias("__src")).distinct(), "edges")
    ored = lambda c, test=None: F.bit_or(F.col(c) if test is None else F.when(test, F.col(c)).otherwise(F.lit(0).cast("long")))
    masks = declared.join(F.broadcast(table), "effect").groupBy(F.col("symbol_id").alias("node")).agg(*(ored(w).alias(w) for w in words))
    state = saved(masks.withColumn("fresh", F.lit(True)), "masks")
    while True:
        for _ in range(hops):
            met = state.join(step, (F.col("node") == F.col("__dst")) & F.col("fresh"), "left")
            own = F.struct("node", *words, F.lit(False).alias("fresh"))
            given = F.struct(F.col("__src").alias("node"), *words, F.lit(True).alias("fresh"))
            rows = met.select(F.explode(F.array(own, given)).alias("r")).select("r.*").where("node IS NOT NULL")
            both = rows.groupBy("node").agg(*(ored(w).alias(w) for w in words), *(ored(w, ~F.col("fresh")).alias(f"old_{w}") for w in words))
            changed = F.lit(False)
            for w in words:
                changed = changed | (F.col(w) != F.col(f"old_{w}"))
            state = both.select("node", *words, changed.alias("fresh"))
        state = saved(state, "masks")
        if state.where("fresh").isEmpty():
            break
    given = step.join(state, F.col("__dst") == F.col("node")).select(F.col("__src").alias("symbol_id"), F.col("__dst").alias("via"), *words)
    held = F.array_compact(F.array(*(F.when(F.col(words[i // WORD]).bitwiseAND(F.lit(1 << i % WORD)) != 0, F.lit(k)) for i, k in enumerate(kinds))))
    brought = given.select("symbol_id", "via", F.explode(held).alias("effect")).groupBy("symbol_id", "effect").agg(F.min("via").alias("via"))
    return brought.join(declared.select("symbol_id", "effect"), ["symbol_id", "effect"], "left_anti")


def blast_radius(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """(effect, root, n): how many symbols inherit an effect that root declares, over callers that don't declare it themselves."""
    own = declared.select("effect", F.col("symbol_id").alias("root"), F.col("symbol_id").alias("node")).distinct()
    stop = saved(declared.select("effect", F.col("symbol_id").alias("node")).distinct(), "declared")
    have = spread(reverse(edges), own, ["effect", "root"], stop, ["effect", "node"])
    return have.groupBy("effect", "root").agg((F.count("*") - 1).alias("n"))


def chains(edges: DataFrame, most: int, longest: int) -> DataFrame:
    """(target, path): for each node with callers the first `most` simple paths that lead to it, callers first, of up to
    `longest` edges; shorter ones first, then by their nodes.  A round extends only the paths of nodes that have too few."""
    step = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))

    def first(paths: DataFrame) -> DataFrame:
        ranked = paths.withColumn("place", F.col("had") + F.row_number().over(Window.partitionBy("target").orderBy("path")))
        return saved(ranked.where(F.col("place") <= most).select("target", "path", "place"), "chains")

    found = first(edges.where("src <> dst").select(F.col("dst").alias("target"), F.array("src", "dst").alias("path"), F.lit(0).alias("had")))
    out = found
    for _ in range(longest - 1):
        had = out.groupBy("target").agg(F.count("*").cast("int").alias("had")).where(F.col("had") < most)
        short = found.select("target", "path").join(had, "target")
        longer = short.join(step, F.element_at("path", 1) == F.col("__dst")).where(~F.array_contains("path", F.col("__src")))
        found = first(longer.select("target", F.concat(F.array("__src"), "path").alias("path"), "had"))
        out = out.unionByName(found)
    return out.select("target", "path")


def communities(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, community): groups that hold more of each other's edges than chance, by merging while modularity rises.

    Edges count once in either direction, loops not at all; a community is named by its least node.  In each round every
    community has a wish, the neighbour with the largest gain.  Of two that wish for each other the larger one stays, and all
    whose wish has stayed move to it, so moves don't cross.  A move counts only if its gain is positive even after all others
    to the same place; where too many want to go for any, a part of them by hash, and the best one else.  So each move raises
    modularity whatever the others do, and it never falls.  What has joined is contracted to one node: rounds work on ever
    smaller graphs.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = saved(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    degree = ends.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("k"))
    label = saved(degree, "nodes")
    twice = float(label.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0])
    k = lambda c: label.select(F.col("node").alias(c), F.col("k").alias(f"k{c}"))
    links = saved(ends.join(k("a"), "a").join(k("b"), "b").select("a", "b", "ka", "kb", F.lit(1).cast("long").alias("w")), "links")
    label = label.select("node", F.col("node").alias("community"))
    for turn in range(1, rounds + 1):
        gain = F.col("w") / twice - F.col("ka") * F.col("kb") / twice**2
        wish = F.max(F.struct("gain", F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("h"), "b", "w", "kb")).alias("wish")
        best = saved(links.withColumn("gain", gain).where("gain > 1e-15").groupBy("a", "ka").agg(wish).select("a", "ka", "wish.*"), "best")
        if best.isEmpty():
            break
        other = best.select(F.col("a").alias("b"), F.col("b").alias("back"))
        mutual = best.join(other, "b").where(F.col("back") == F.col("a"))
        stays = mutual.where(F.struct("ka", "a") > F.struct("kb", "b")).select(F.col("a").alias("b"))
        room = F.col("w") * twice / F.col("ka") - F.col("kb")  # the degrees that may join before the gain is gone
        wishes = best.join(stays, "b").join(stays.select(F.col("b").alias("a")), "a", "left_anti").withColumn("room", room)
        wanted = wishes.groupBy("b").agg(F.sum("ka").alias("all"), F.max("room").alias("most"), F.max(F.struct("gain", "a")).alias("first"))
        thin = F.least(F.lit(40), F.greatest(F.lit(0), F.ceil(F.log2(F.col("all") / F.greatest("most", F.lit(1.0)))))).cast("int")
        part = wishes.join(wanted, "b").withColumn("in", F.pmod(F.xxhash64("a", F.lit(turn)), F.pow(F.lit(2.0), thin).cast("long")) == 0)
        sums = part.where("in").groupBy("b").agg(F.sum("ka").alias("joining"))
        judged = part.join(sums, "b", "left").withColumn("sure", F.coalesce(F.col("in") & (F.col("joining") - F.col("ka") < F.col("room")), F.lit(False)))
        some = judged.groupBy("b").agg(F.max("sure").alias("some"))
        moves = judged.join(some, "b").where(F.col("sure") | ~F.col("some") & (F.col("first.a") == F.col("a"))).select("a", "b", "ka", "kb")
        moves = saved(moves, "moves")
        named = moves.groupBy("b", "kb").agg(F.min("a").alias("least"), F.sum("ka").alias("more")).select("b", F.least("b", "least").alias("name"), (F.col("kb") + F.col("more")).alias("size"))
        renamed = saved(moves.select("a", "b").join(named, "b").select(F.col("a").alias("old"), "name", "size").unionByName(named.select(F.col("b").alias("old"), "name", "size")), "renamed")

        def moved(df, c):
            new = renamed.select(F.col("old").alias(c), "name", "size")
            return df.join(new, c, "left").withColumns({c: F.coalesce("name", c), f"k{c}": F.coalesce("size", f"k{c}")}).drop("name", "size")

        links = saved(moved(moved(links, "a"), "b").where("a <> b").groupBy("a", "b", "ka", "kb").agg(F.sum("w").alias("w")), "links")
        label = label.join(renamed.select(F.col("old").alias("community"), "name"), "community", "left").select("node", F.coalesce("name", "community").alias("community"))
        if turn % 4 == 0:
            label = saved(label, "label")
    return label


def modularity(edges: DataFrame, label: DataFrame) -> float:
    """How much more of the edges (once in either direction, no loops) lies within communities than chance would put there."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    of = lambda name: label.select(F.col("node").alias(name), F.col("community").alias(f"c{name}"))
    own = pairs.join(of("a"), "a").join(of("b"), "b")
    m, inside = own.agg(F.count("*"), F.sum((F.col("ca") == F.col("cb")).cast("long"))).first()
    if not m:
        return 0.0
    ends = own.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").count()
    return inside / m - ends.agg(F.sum((F.col("count") / (2.0 * m)) ** 2)).first()[0]
