"""The sharing graph as an edge table ``src, dst, w``; nothing is collected.

Loops run on the driver only to decide whether another round is needed; each
round is one Spark job whose result is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from murmura.operators.ranking import top_n
from murmura.operators.skew import hot_keys, join_unique, with_global_order
from murmura.runtime import BROADCAST_ROWS, materialize
from murmura.schema import COUNT


def share_edges(shares: DataFrame) -> DataFrame:
    """Shares per (sharer, author)."""
    return (shares.filter(F.col("uid").isNotNull() & F.col("ouid").isNotNull())
            .groupBy(F.col("uid").alias("src"), F.col("ouid").alias("dst"))
            .agg(F.count("*").cast("double").alias("w")))


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def edge_ends(edges: DataFrame) -> DataFrame:
    """Every edge once per end, as ``id``; one pass over the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def nodes(edges: DataFrame) -> DataFrame:
    return edge_ends(edges).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In-degree plus out-degree; a reciprocal pair counts as two edges."""
    return edge_ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def node_numbers(ids: DataFrame) -> DataFrame:
    """Stable integer per node, 0, 1, ... in order of the id."""
    return with_global_order(ids.select("id"), ["id"], number="store_id", label="nodes")


def build_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label, store_id`` implied by the edges, and the edges."""
    numbered = node_numbers(nodes(edges)).withColumn("label", F.col("id"))
    return numbered.select("id", "label", "store_id"), edges


def simple_neighbours(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbours in both directions, without self-loops."""
    both = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nb")),
                             F.struct(F.col("dst").alias("id"), F.col("src").alias("nb"))))
    return drop_self_loops(edges).select(both.alias("e")).select("e.id", "e.nb").distinct()


def keep_nodes(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Induced sub-graph: edges with both ends in ``kept.id``."""
    return (edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi")
            .join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
            .select(*edges.columns))


def _few(df: DataFrame, rows: int, limit: int | None = None) -> DataFrame:
    """A side of a counted number of rows, broadcast while that number is small."""
    return F.broadcast(df) if rows <= (limit or BROADCAST_ROWS) else df


def _meet(big: DataFrame, side: DataFrame, key: str, size: int, how: str = "inner",
          limit: int | None = None, hot: list | None = None) -> DataFrame:
    """Join to a side of ``size`` rows with unique ``key``, broadcast while these are few."""
    if size <= (limit or BROADCAST_ROWS):
        return big.join(F.broadcast(side), key, how)
    return join_unique(big, side, key, how, hot=hot)


def _counted(df: DataFrame, flag: str, label: str) -> tuple[DataFrame, int]:
    """Write a round's table and count its flagged rows in the same job."""
    seen = Observation()
    kept = materialize(df.observe(seen, F.count_if(flag).alias("n")), label)
    return kept, seen.get["n"]


def k_core(edges: DataFrame, k: int = 2, mode: str = "directed") -> DataFrame:
    """Edges of the k-core: nodes below degree k go until none is left below.

    ``directed`` counts in and out edges, ``simple`` distinct neighbours.
    Self-loops are removed first. The loop's state is one row per node with what is left of its
    degree. In each round only the nodes that have just gone send messages, to take their links
    off their neighbours' degrees; edges are filtered once, at the end.
    """
    if mode == "directed":
        both = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nb")),
                                 F.struct(F.col("dst").alias("id"), F.col("src").alias("nb"))))
        pairs = (drop_self_loops(edges).select(both.alias("e")).groupBy("e.id", "e.nb")
                 .agg(F.count("*").alias("n")))
    else:
        pairs = simple_neighbours(edges).withColumn("n", F.lit(1).cast("long"))
    pairs = materialize(pairs, "pairs")
    state, going = _counted(pairs.groupBy("id").agg(F.sum("n").alias("degree")).withColumn(
        "gone", F.col("degree") < k), "gone", "kcore")
    while going:
        lost = (pairs.join(_few(state.filter("gone").select(F.col("id").alias("nb")), going), "nb")
                .groupBy("id").agg(F.sum("n").alias("lost")))
        # Nodes that went before have no row any more; a node's last row says gone once.
        left = state.filter(~F.col("gone")).join(lost, "id", "left").select(
            "id", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree"))
        state, going = _counted(left.withColumn("gone", F.col("degree") < k), "gone", "kcore")
    return materialize(keep_nodes(drop_self_loops(edges), state), "kcore")


def core_numbers(edges: DataFrame) -> DataFrame:
    """Core number of every node with a neighbour, by repeated H-index.

    Estimates start at the degree. A node's next estimate is the largest i with at
    least i neighbours of estimate >= i. Only nodes with a neighbour whose estimate has just
    fallen are looked at again. Neighbours are first counted per value, and
    there are at most about sqrt(2 * edges) different values, so a hub with a third
    of all edges is a short histogram by the time it is ranked.
    """
    pairs = materialize(simple_neighbours(edges), "pairs")
    core = materialize(pairs.groupBy("id").agg(
        F.count("*").alias("core"), F.lit(True).alias("fell")), "core")
    fallen = size = core.count()
    hot = [] if size <= BROADCAST_ROWS else hot_keys(pairs, "nb")
    falling = Window.partitionBy("id").orderBy(F.col("value").desc())
    again = pairs
    while fallen:
        known = core.select(F.col("id").alias("nb"), F.col("core").alias("value"))
        met = (again.join(F.broadcast(known), "nb") if size <= BROADCAST_ROWS
               else join_unique(again, known, "nb", hot=hot))
        histogram = met.groupBy("id", "value").agg(F.count("*").alias("n"))
        bound = (histogram.withColumn("above", F.sum("n").over(falling))
                 .groupBy("id").agg(F.max(F.least("value", "above")).alias("bound")))
        core, fallen = _counted(
            core.join(_few(bound, size), "id", "left").select(
                "id", F.least("core", "bound").alias("core"),
                F.coalesce(F.col("bound") < F.col("core"), F.lit(False)).alias("fell")),
            "fell", "core")
        near = pairs.join(_few(core.filter("fell").select(F.col("id").alias("nb")), fallen), "nb",
                          "left_semi").select("id").distinct()
        again = pairs.join(_few(near, size), "id", "left_semi")
    return core.select("id", "core")


def above_core(edges: DataFrame, core: DataFrame, floor: int = 1) -> DataFrame:
    """Sub-graph of nodes with core number above ``floor``."""
    return keep_nodes(edges, core.filter(F.col("core") > floor))


# --- communities -------------------------------------------------------------

NUMBERED_ROWS = 1_000_000
"""Nodes up to which a few numbers of each, or its name, may be broadcast: some 80 bytes a node."""


def _numbered(links: DataFrame, ids: DataFrame, how: str) -> tuple[DataFrame, DataFrame, int]:
    """Links between numbers in order of the ids, the ids by number, and how many there are.

    Numbers are joined and counted in half the bytes of names and without sorting, and their
    smallest is kept in place.
    """
    names = materialize(node_numbers(ids.select("id").distinct()), "nodes")
    size = names.count()
    for end in ("a", "b"):
        numbers = names.select(F.col("id").alias(end), F.col("store_id").alias(f"_{end}"))
        links = _meet(links, numbers, end, size, how, NUMBERED_ROWS)
    numbered = materialize(links.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "w"), "links")
    return numbered, names.select(F.col("store_id").alias("id"), F.col("id").alias("name")), size


def undirected(edges: DataFrame) -> DataFrame:
    """Weights of unordered pairs as ``a <= b``; a self-loop has ``a = b``."""
    return (edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
            .agg(F.sum("w").alias("w")))


def node_weights(links: DataFrame) -> DataFrame:
    """Weighted degree of undirected links; a self-loop counts twice."""
    return (links.select(F.explode(F.array("a", "b")).alias("id"), "w")
            .groupBy("id").agg(F.sum("w").alias("k")))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a labelling ``id, community`` of the undirected graph.

    ``sum over communities of inside / m - resolution * (degree / 2m)^2``.
    """
    return _modularity(undirected(edges), labels, resolution)


def _marked(links: DataFrame, labels: DataFrame, size: int | None = None) -> DataFrame:
    """Links with the communities of both ends; ``size`` of numbered labels, if it is known."""
    for end in ("a", "b"):
        of_end = labels.select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
        links = (join_unique(links, of_end, end) if size is None
                 else _meet(links, of_end, end, size, limit=NUMBERED_ROWS))
    return links


def _modularity(links: DataFrame, labels: DataFrame, resolution: float,
                size: int | None = None) -> DataFrame:
    marked = _marked(links, labels, size)
    # Each link adds its weight to the degree of both ends' communities and, when
    # they are one, to the inside weight.
    ends = F.explode(F.array(
        F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("w"))
                 .otherwise(0.0).alias("inside")),
        F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("inside"))))
    per = (marked.select("w", ends.alias("e"))
           .groupBy("e.c").agg(F.sum("w").alias("degree"), F.sum("e.inside").alias("inside")))
    m2 = F.sum("degree")
    return per.agg((2 * F.sum("inside") / m2
                    - resolution * F.sum(F.col("degree") * F.col("degree")) / (m2 * m2))
                   .alias("modularity"))


CHECKED = 8
"""Rounds of moves after which modularity must have grown."""


def communities(edges: DataFrame, resolution: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """Communities of high modularity: ``id, community``, by parallel Louvain.

    In each round a pseudo-random half of the nodes may move to the neighbouring
    community with the largest gain; the other half stays, which keeps two nodes
    from swapping for ever. Only nodes whose neighbours have just moved, or that wait for their
    turn, are looked at; when none is left all are looked at once more. When no node wants to
    move, or moves no longer raise modularity, communities become nodes and the next level begins,
    until modularity no longer grows. Communities in several parts are split into these, which
    only raises modularity. A larger ``resolution`` gives
    smaller communities. Community 0 is the largest; ties go to the smaller id.
    """
    links = materialize(undirected(edges), "links")
    links, names, size = _numbered(links, links.select(F.explode(F.array("a", "b")).alias("id")), "left")
    original = links
    mapping = best = None
    best_q, level = float("-inf"), 0
    while True:
        labels = _move_nodes(links, names, resolution, level, tolerance)
        mapping = labels if mapping is None else materialize(
            mapping.select("id", F.col("community").alias("_at"))
            .join(labels.select(F.col("id").alias("_at"), "community"), "_at")
            .select("id", "community"), "mapping")
        quality = _modularity(original, mapping, resolution, size).first()["modularity"]
        if quality is None or quality <= best_q + tolerance:
            break
        best, best_q, level = mapping, quality, level + 1
        links = _contract(links, labels, size)
    found = name_by_size(_parts(original, best if best is not None else mapping, size))
    return found.join(_few(names, size, NUMBERED_ROWS), "id").select(F.col("name").alias("id"), "community")


def connected_parts(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, community`` with each community cut into its connected parts.

    Every node takes the smallest id among its part's nodes, by repeatedly looking at its
    neighbours and then at what the node it points to points to.
    """
    numbered, names, size = _numbered(links, labels, "inner")
    names = _few(names, size, NUMBERED_ROWS)
    known = labels.withColumnRenamed("id", "name").join(names, "name")
    parts = _parts(numbered, known.select("id", "community"), size)
    firsts = _few(names.select(F.col("id").alias("community"), F.col("name").alias("first")), size,
                  NUMBERED_ROWS)
    return (parts.join(names, "id").join(firsts, "community")
            .select(F.col("name").alias("id"), F.col("first").alias("community")))


def _parts(links: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Connected parts of numbered nodes, ``size`` of them, by their smallest number."""
    inside = _marked(links, labels, size).filter(
        (F.col("ca") == F.col("cb")) & (F.col("a") != F.col("b")))
    turned = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nb")),
                               F.struct(F.col("b").alias("id"), F.col("a").alias("nb"))))
    around = materialize(inside.select(turned.alias("e")).select("e.id", "e.nb"), "inside")
    state = materialize(labels.select("id", F.col("id").alias("part"),
                                      F.lit(True).alias("changed")), "parts")
    changed = 1
    hot = [] if size <= NUMBERED_ROWS else hot_keys(around, "nb")
    while changed:
        at = state.select(F.col("id").alias("nb"), "part")
        met = _meet(around, at, "nb", size, limit=NUMBERED_ROWS, hot=hot)
        least = met.groupBy("id").agg(F.min("part").alias("near"))
        nearer = state.join(least, "id", "left").select(
            "id", "part", F.least("part", "near").alias("next"))
        jump = _few(state.select(F.col("id").alias("next"), F.col("part").alias("far")), size,
                    NUMBERED_ROWS)
        state, changed = _counted(
            nearer.join(jump, "next").select(
                "id", F.least("next", "far").alias("part"),
                (F.least("next", "far") < F.col("part")).alias("changed")),
            "changed", "parts")
    return state.select("id", F.col("part").alias("community"))


def _contract(links: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    return materialize(
        _marked(links, labels, size).groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        .agg(F.sum("w").alias("w")), "links")


def _move_nodes(links: DataFrame, names: DataFrame, resolution: float, level: int,
                tolerance: float) -> DataFrame:
    state = materialize(node_weights(links).join(names, "id", "left").select(
        "id", "name", "k", F.col("id").alias("community"), F.lit(False).alias("moved"),
        F.lit(True).alias("waits"), F.xxhash64("name", F.lit(level)).alias("dice")), "state")
    node_count, m2 = state.agg(F.count("*"), F.sum("k")).first()
    turned = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nb")),
                               F.struct(F.col("b").alias("id"), F.col("a").alias("nb"))))
    around = materialize(links.filter(F.col("a") != F.col("b"))
                         .select(turned.alias("e"), "w").select("e.id", "e.nb", "w"), "around")
    # Both columns hold the same ids equally often, so one list serves either join.
    hot = [] if node_count <= NUMBERED_ROWS else hot_keys(around, "id")
    best, best_q = state, float("-inf")
    everyone, turn, wanting = True, 0, node_count
    while node_count:
        # While many want to move, half of them wait; later neighbours seldom move at once.
        state, wanting, moved = _one_round(around, state, m2, resolution, hot, node_count,
                                           everyone, 4 if 2 * wanting > node_count else 7)
        turn += 1
        if turn % CHECKED == 0:
            quality = _modularity(links, state.select("id", "community"), resolution,
                                  node_count).first()["modularity"]
            if quality <= best_q + tolerance:
                return best.select("id", "community")
            best, best_q = state, quality
        if not wanting and everyone:
            break
        everyone = not wanting and not moved
    if best_q > float("-inf"):
        quality = _modularity(links, state.select("id", "community"), resolution,
                              node_count).first()["modularity"]
        state = state if quality >= best_q else best
    return state.select("id", "community")


def _one_round(around: DataFrame, state: DataFrame, m2: float, resolution: float, hot: list,
               size: int, everyone: bool, eighths: int) -> tuple[DataFrame, int, int]:
    # The dice are a column and not a literal, so every round runs the code compiled for the first.
    totals = state.groupBy("community").agg(F.sum("k").alias("total"))
    few = size <= NUMBERED_ROWS  # one row per node, and the nodes were counted
    placed = (state.join(F.broadcast(totals), "community") if few
              else join_unique(state, totals, "community"))
    looked = around
    if not everyone:
        stirred = _few(state.filter("moved").select(F.col("id").alias("nb")), size, NUMBERED_ROWS)
        active = (around.join(stirred, "nb", "left_semi").select("id")
                  .union(state.filter(F.col("moved") | F.col("waits")).select("id")).distinct())
        looked = around.join(_few(active, size, NUMBERED_ROWS), "id", "left_semi")
    at = placed.select(F.col("id").alias("nb"), "community", "total")
    towards = (_meet(looked, at, "nb", size, limit=NUMBERED_ROWS, hot=hot)
               .groupBy("id", "community")
               .agg(F.sum("w").alias("inward"), F.max("total").alias("total")))
    mine = placed.select("id", "k", F.col("community").alias("own"), F.col("total").alias("own_total"))
    # Rounding makes equal gains tie exactly, so that the smaller id decides.
    gain = F.round(F.col("inward") - resolution * F.col("k") * F.col("total") / m2, 9)
    # Staying is a choice too: links to a node's own community are found in the same pass.
    best = (_meet(towards, mine, "id", size, limit=NUMBERED_ROWS, hot=hot)
            .withColumn("gain", gain).groupBy("id")
            .agg(F.max("gain").alias("gain"),
                 F.min_by("community", F.struct(-F.col("gain"), "community")).alias("choice"),
                 F.max(F.when(F.col("community") == F.col("own"), F.col("inward"))).alias("inward"),
                 *[F.max(c).alias(c) for c in ("k", "own", "own_total")]))
    stay = F.round(F.coalesce("inward", F.lit(0.0))
                   - resolution * F.col("k") * (F.col("own_total") - F.col("k")) / m2, 9)
    wants = (F.col("choice") != F.col("own")) & (F.col("gain") > stay)
    may_move = F.pmod("dice", F.lit(8)) < eighths
    decided = best.select("id", "choice", F.coalesce(wants, F.lit(False)).alias("wants"))
    go = F.coalesce(F.col("wants") & may_move, F.lit(False))
    seen = Observation()
    after = (state.select("id", "name", "k", "community", "dice")
             .join(_few(decided, size, NUMBERED_ROWS), "id", "left").select(
        "id", "name", "k", F.when(go, F.col("choice")).otherwise(F.col("community")).alias("community"),
        go.alias("moved"), F.coalesce(F.col("wants") & ~may_move, F.lit(False)).alias("waits"),
        F.xxhash64("dice", "name").alias("dice"))
        .observe(seen, F.count_if("waits").alias("waiting"), F.count_if("moved").alias("moved")))
    kept = materialize(after, "state")
    return kept, seen.get["waiting"] + seen.get["moved"], seen.get["moved"]


def community_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("community").agg(F.count("*").alias("size"))


def name_by_size(labels: DataFrame) -> DataFrame:
    """Rename communities 0, 1, ... by size, largest first, then smallest member."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"),
                                            F.min("id").alias("first"))
    names = with_global_order(sizes, ["size", "first"], ["size"], number="name",
                              label="communities")
    named = join_unique(labels, names.select("community", "name"), "community")
    return named.select("id", F.col("name").alias("community"))


def top_communities(labels: DataFrame, k: int | None = None,
                    coverage: float | None = None) -> DataFrame:
    """The k largest communities, or the largest ones up to a share of the nodes.

    In coverage mode a community is taken while the nodes taken before it are fewer
    than ``coverage * nodes``. Ties in size go to the smaller community.
    """
    sizes = community_sizes(labels)
    if k is not None:
        # A limit on a sort keeps k rows per task; k is the report's length.
        return sizes.orderBy(F.col("size").desc(), "community").limit(k)
    coverage = 0.9 if coverage is None else coverage
    total = labels.count()
    ordered = with_global_order(sizes, ["size", "community"], ["size"],
                                running={"size": "before"}, label="coverage")
    return ordered.filter(F.col("before") < coverage * total).select("community", "size")


def community_graph(edges: DataFrame, labels: DataFrame, coords: DataFrame | None = None,
                    k: int | None = None, coverage: float | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the kept communities.

    Nodes: ``label, id, degree, community, x, y, z``; edges with both ends kept:
    ``source, target, weight`` by label.
    """
    kept = top_communities(labels, k, coverage).select("community")
    members = materialize(labels.join(kept, "community", "left_semi"), "members")
    numbered = node_numbers(labels).select(F.col("id").alias("label"),
                                           F.col("store_id").alias("id"))
    points = members.join(degrees(edges), "id").withColumnRenamed("id", "label")
    points = points.join(numbered, "label")
    if coords is None:
        points = points.select("*", *[F.lit(0.0).alias(c) for c in ("x", "y", "z")])
    else:
        points = points.join(coords.withColumnRenamed("id", "label"), "label", "left")
    lines = keep_nodes(edges, members).select(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.col("w").alias("weight"))
    return points.select("label", "id", "degree", "community", "x", "y", "z"), lines


# --- what a community talks about ---------------------------------------------

def community_posts(shares: DataFrame, membership: DataFrame, side: str = "uid") -> DataFrame:
    """Shares with their community: by sharer, or by sharer or author (``either``).

    ``either`` is two equality joins and a de-duplication, never an OR-join.
    """
    members = membership.select("uid", "community")
    by_sharer = join_unique(shares, members, "uid")
    if side == "uid":
        return by_sharer
    authors = members.withColumnRenamed("uid", "ouid")
    by_author = join_unique(shares, authors, "ouid")
    return by_sharer.unionByName(by_author).dropDuplicates(["post_id", "community"])


def community_sentiment(posts: DataFrame, normalize: bool = False,
                        group: str = "community") -> DataFrame:
    """Positive, negative and neutral posts per community, or their shares."""
    s = F.col("sentiment")
    out = posts.groupBy(group).agg(F.count_if(s == 1).alias("positive"),
                                   F.count_if(s == -1).alias("negative"),
                                   F.count_if(s == 0).alias("neutral"))
    if not normalize:
        return out
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    return out.select(group, *[(F.col(c) / total).alias(c)
                               for c in ("positive", "negative", "neutral")])


def community_words(posts: DataFrame, group: str = "community", tokens: str = "toks") -> DataFrame:
    """Word counts per community without handles."""
    return (posts.select(group, F.explode_outer(tokens).alias("word"))
            .filter(F.col("word").isNotNull() & ~F.col("word").startswith("@"))
            .groupBy(group, "word").agg(F.count("*").alias(COUNT)))


def community_wordcloud(posts: DataFrame, n: int, group: str = "community",
                        tokens: str = "toks") -> DataFrame:
    """The n most used words per community."""
    return top_n(community_words(posts, group, tokens), [group], n, ties=["word"])
