"""Weighted graph over triples: construction, PageRank, components and leader clusters.

Iterations run as joins and aggregates; lineage is cut through the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import text as TX
from furrow.session import cut_lineage, shuffled_for

# Edge weights by kind of verb.
LOW_VERB_WEIGHT, STANCE_WEIGHT, PRICE_DEMAND_WEIGHT, DEFAULT_WEIGHT = 0.05, 1.0, 0.8, 1.0
# What stance and price/demand verbs are described by.
STANCE_DESCRIPTIONS = [
    "doubt, question, warn, downgrade, cut, default, risk, alert, caution, concern",
    "agreement, deal, contract, commitment, promise, settle, merge, acquire",
    "ban, sanction, embargo, restriction, regulate, implement, enforce",
    "profit, loss, gain, revenue, invest, divest, fail, breach, litigate, dispute",
]
PRICE_DEMAND_DESCRIPTIONS = [
    "prices rise, prices fall, value increased, value decreased",
    "market arrivals, oversupply, shortage, supply reduced, imported by, demand",
]
STANCE_TERMS = [t for d in STANCE_DESCRIPTIONS for t in d.split(", ")]
PRICE_DEMAND_TERMS = [t for d in PRICE_DEMAND_DESCRIPTIONS for t in d.split(", ")]
SIMILARITY_THRESHOLD, TRIPLE_THRESHOLD = 0.65, 0.68
BROADCAST_PLURALS = 200_000


def edge_weight(verb: Column, is_stance: Column, is_price_demand: Column) -> Column:
    return (
        F.when(TX.is_low_weight_verb(verb), LOW_VERB_WEIGHT).when(is_stance, STANCE_WEIGHT)
        .when(is_price_demand, PRICE_DEMAND_WEIGHT).otherwise(DEFAULT_WEIGHT)
    )


def build_edges(triples: DataFrame, weight: Column, keys: Sequence[str] = ()) -> DataFrame:
    """One edge per (s, o): the last triple by position gives verb and weight."""
    last = F.max_by(F.struct(F.col("v").alias("verb"), F.col("weight")), "pos")
    return triples.withColumn("weight", weight).groupBy(*keys, "s", "o").agg(last.alias("_e")).select(
        *keys, F.col("s").alias("src"), F.col("o").alias("dst"), "_e.verb", "_e.weight")


def nodes_of(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ends = edges.select(*keys, F.col("src").alias("id")).union(edges.select(*keys, F.col("dst").alias("id")))
    return ends.distinct()


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.85, tol: float = 1e-10, max_rounds: int = 400,
             rounds_per_check: int = 8, hub_edges: int = 100_000, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted PageRank per graph (`keys` name the graph; none for a single one): (keys, id, rank).

    Mass of nodes without outgoing weight is spread evenly and isolated nodes take part. That spread only scales the
    fixed point, so the rounds leave it out; the scale is set to one at the end. The edges
    are placed by source once and stay there; where a node is a hub, edges are split over several join keys, its rank being
    copied to each, so that no task holds them all. Rounds are chained, written out, and go on from the best mixture of
    the last two, which about halves their number; the last one's change decides: all
    ranks together must move by less than `tol` of their sum, whatever the number of nodes. Ranks that have not
    settled after `max_rounds` (several times what alpha and tol ask for) raise.
    """
    if not keys:  # a single graph is a graph with a constant name
        name = F.lit(0).alias("_graph")
        whole = pagerank(edges.select(name, "*"), None if nodes is None else nodes.select(name, "*"), alpha, tol, max_rounds,
                         rounds_per_check, hub_edges, ["_graph"])
        return whole.drop("_graph")
    keys = list(keys)
    joined = [*keys, "id"]
    # Scalars of a single graph are one row; those of many graphs join as Spark sees fit.
    small = F.broadcast if keys == ["_graph"] else (lambda df: df)
    edges = cut_lineage(edges.select(*keys, "src", "dst", "weight"))
    nodes = (nodes_of(edges, keys) if nodes is None else nodes.select(*joined)).distinct()
    heavy = edges.where(F.col("weight") > 0).select(*keys, F.col("src").alias("id"), "dst", "weight")
    out = heavy.groupBy(*joined).agg(F.sum("weight").alias("out_weight"), F.count(F.lit(1)).alias("_degree"))
    graphs = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    base = nodes.join(small(graphs), keys).join(out, joined, "left").select(
        *joined, "out_weight", ((1 - alpha) / F.col("n")).alias("teleport"),
        F.coalesce(F.ceil(F.col("_degree") / hub_edges), F.lit(0)).cast("int").alias("parts"))  # none: nothing goes out
    base = cut_lineage(base)
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = heavy.join(base.select(*joined, "parts", "out_weight"), joined).select(
        *joined, "parts", "dst", (alpha * F.col("weight") / F.col("out_weight")).alias("share"))
    hubs = base.where("parts > 1").limit(1).count() > 0
    if hubs:
        moves = shares.withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")).drop("parts")
        moves = cut_lineage(moves.repartition(width, *joined, "part"))
    else:  # beside its edges a node has a row of its own, so that one join brings both
        rows = shares.drop("parts").unionByName(base.select(*joined, F.col("id").alias("dst"), "parts", "teleport"), allowMissingColumns=True)
        moves = cut_lineage(rows.repartition(width, *joined).sortWithinPartitions(*joined))

    def step(state: DataFrame) -> DataFrame:
        if not hubs:
            # Ranks come out of the sums placed as the edges are: a round shuffles the inflow and nothing else.
            own = F.col("parts").isNotNull()
            sent = state.select(*joined, "rank", "previous").join(moves, joined).select(
                *keys, F.col("dst").alias("id"), "parts", "teleport", F.when(own, F.col("rank")).alias("kept"),
                F.when(own, F.col("previous")).alias("earlier"), F.when(own, 0.0).otherwise(F.col("rank") * F.col("share")).alias("inflow"))
            return summed(sent)
        # Part -1 carries the node itself, the others its rank to the edges. The state is read once per round, so that
        # a chain of rounds stays a chain.
        copies = state.drop("earlier").withColumn("part", F.explode(F.sequence(F.lit(-1), F.col("parts") - 1)))
        own = F.col("part") == -1
        sent = copies.join(moves, [*joined, "part"], "left").where(own | F.col("dst").isNotNull()).select(
            *keys, F.when(own, F.col("id")).otherwise(F.col("dst")).alias("id"),
            *[F.when(own, F.col(c)).alias(c) for c in ("parts", "teleport")], F.when(own, F.col("rank")).alias("kept"),
            F.when(own, F.col("previous")).alias("earlier"), F.when(own, 0.0).otherwise(F.col("rank") * F.col("share")).alias("inflow"))
        return summed(sent)

    def summed(sent: DataFrame) -> DataFrame:
        return sent.groupBy(*joined).agg(
            F.max("parts").alias("parts"), F.max("teleport").alias("teleport"), F.max("kept").alias("previous"), F.max("earlier").alias("earlier"),
            (F.max("teleport") + F.sum("inflow")).alias("rank"))

    first = F.col("teleport") / (1 - alpha)
    state, done = base.select(*joined, "parts", "teleport", first.alias("previous"), first.alias("rank")), 0
    while done < max_rounds:
        for _ in range(min(rounds_per_check, max_rounds - done)):
            state = step(state)
            done += 1
        state = cut_lineage(state)
        before, now = F.col("previous") - F.col("earlier"), F.col("rank") - F.col("previous")
        moved = F.sum(F.abs(now)) / F.sum("rank")
        # The mixture of the last two ranks that moves least, by least squares: rounds are linear, so it moves as the
        # same mixture of their moves, by no more than the last one.
        back = F.sum(now * (now - before)) / F.nullif(F.sum((now - before) * (now - before)), F.lit(0.0))
        per_graph = state.groupBy(*keys).agg(moved.alias("moved"), F.coalesce(back, F.lit(0.0)).alias("back"))
        worst = per_graph.agg(F.max("moved")).first()[0]
        if worst is None or worst < tol:
            break
        mixed = F.col("rank") + F.col("back") * (F.col("previous") - F.col("rank"))
        state = state.join(small(per_graph.select(*keys, "back")), keys).withColumn("rank", mixed).drop("back")
    else:
        raise RuntimeError(f"ranks not settled after {max_rounds} rounds")
    total = state.groupBy(*keys).agg(F.sum("rank").alias("_total"))
    return state.join(small(total), keys).select(*joined, (F.col("rank") / F.col("_total")).alias("rank"))


def verb_contribution(edges: DataFrame, ranks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over a verb's edges of the rank of both ends."""
    keys = list(keys)
    s = ranks.select(*keys, F.col("id").alias("src"), F.col("rank").alias("rank_s"))
    o = ranks.select(*keys, F.col("id").alias("dst"), F.col("rank").alias("rank_o"))
    scored = edges.join(s, [*keys, "src"]).join(o, [*keys, "dst"])
    return scored.groupBy(*keys, "verb").agg(F.avg(F.col("rank_s") + F.col("rank_o")).alias("score"))


def graph_stats(edges: DataFrame, nodes: DataFrame, triples: DataFrame) -> DataFrame:
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(what))
    counts = one(nodes, "nodes").unionByName(one(edges, "edges")).unionByName(one(triples, "triples"))
    return counts.agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("nodes", "edges", "triples")])


def touching_triples(triples: DataFrame, top: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Triples with a top entity at either end and a telling verb, with the edge weight times both ranks."""
    flagged = ranks.join(top.select("id", F.lit(1).alias("is_top")), "id", "left")
    s = flagged.select(F.col("id").alias("s"), F.col("rank").alias("rank_s"), F.col("is_top").alias("top_s"))
    o = flagged.select(F.col("id").alias("o"), F.col("rank").alias("rank_o"), F.col("is_top").alias("top_o"))
    weights = edges.select(F.col("src").alias("s"), F.col("dst").alias("o"), "weight")
    told = triples.where(~TX.is_low_weight_verb(F.col("v")))
    both = told.join(s, "s", "left").join(o, "o", "left").where(F.col("top_s").isNotNull() | F.col("top_o").isNotNull())
    zero = F.lit(0.0)
    score = F.coalesce(F.col("weight"), zero) * (F.coalesce(F.col("rank_s"), zero) + F.coalesce(F.col("rank_o"), zero))
    return both.join(weights, ["s", "o"], "left").select(
        *triples.columns, score.alias("importance"),
        F.array_compact(F.array(F.when(F.col("top_s") == 1, F.col("s")), F.when(F.col("top_o") == 1, F.col("o")))).alias("top_ends"))


def triple_keywords(touching: DataFrame, text: str = "triple_text") -> DataFrame:
    """Top entities found in each triple text, sorted; two per triple at most, so the set stays small."""
    ends = touching.select(text, F.explode("top_ends").alias("entity")).distinct()
    return ends.groupBy(text).agg(F.array_sort(F.collect_set("entity")).alias("keywords"))


# --- normalisation of triples ----------------------------------------------------------------------------------------


def normalised_triples(triples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Valid triples with normalised ends; the raw ends stay beside them as raw_s and raw_o. `keys` name the set of
    triples within which plurals are merged.

    The plurals are counted: up to 200 000 go to the tasks that hold the triples, which then are neither shuffled nor
    sorted; more are joined in partitions of bounded size.
    """
    s, o = F.col("s"), F.col("o")
    valid = triples.where(TX.is_valid_entity(s) & TX.is_valid_entity(o))
    named = valid.withColumns({"raw_s": s, "raw_o": o, "s": TX.graph_entity(s), "o": TX.graph_entity(o)})
    named = cut_lineage(named)  # names are needed three times, and making them is the costly part
    with shuffled_for(named.sparkSession, named.count()):
        plurals = cut_lineage(plural_map(entities_of(named, keys), keys))
        if plurals.count() <= BROADCAST_PLURALS:
            return replace_ends(named, F.broadcast(plurals), "entity", "singular", keys)
        return cut_lineage(replace_ends(named, plurals, "entity", "singular", keys))


def entities_of(triples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return nodes_of(triples.select(*keys, F.col("s").alias("src"), F.col("o").alias("dst")), keys).withColumnRenamed("id", "entity")


def plural_map(entities: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, entity, singular) for single words in -s whose singular is an entity as well."""
    e = F.col("entity")
    plural = entities.where(~e.contains(" ") & ~e.contains("'") & e.endswith("s") & (F.length(e) > 3))
    named = plural.withColumn("singular", F.expr("substring(entity, 1, length(entity) - 1)"))
    held = entities.select(*keys, F.col("entity").alias("singular"))
    return named.join(held, [*keys, "singular"], "left_semi").select(*keys, "entity", "singular")


def replace_ends(triples: DataFrame, mapping: DataFrame, source: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Both ends through the mapping; an end it does not hold stays."""
    for end in ("s", "o"):
        side = mapping.select(*keys, F.col(source).alias(end), F.col(target).alias("_to"))
        triples = triples.join(side, [*keys, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return triples


# --- clustering ------------------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, nodes: DataFrame, a: str = "id_a", b: str = "id_b", id_col: str = "id",
                         max_rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable, by alternating stars until the edge set stands still.

    Each round hooks neighbours to the smallest node around them. Node neighbourhoods are only ever aggregated to
    their minimum, never gathered.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    e = cut_lineage(edges.select(hi, lo).where(F.col("hi") != F.col("lo")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = cut_lineage(small.union(root.select("hi", F.col("m").alias("lo"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    label = e.select(F.col("hi").alias(id_col), F.col("lo").alias("component"))
    return nodes.select(id_col).distinct().join(label, id_col, "left").withColumn("component", F.coalesce("component", id_col))


def free_order(id_: Column) -> Column:
    """An order for leader clustering where none is given: by digest, so that chains of decisions stay short."""
    return F.md5(id_.cast("string").cast("binary"))


def cluster_leaders(items: DataFrame, pairs: DataFrame, id_col: str = "id", order: str = "id") -> DataFrame:
    """Greedy leader clustering in the given order: (id, leader).

    An item leads unless an earlier leader is paired with it, and follows the earliest such leader. Decided in
    rounds: whoever has only followers before it leads; whoever has a leader before it follows. Every round decides the
    first open item at least, so the rounds end; there is no limit to them. Pairs of decided items are left out.
    """
    # `pairs` hold id_a, id_b of similar items; they are turned so that `before` comes first in the order.
    ranks = items.select(F.col(id_col).alias("x"), F.col(order).alias("at"))
    ra, rb = ranks.withColumnsRenamed({"x": "id_a", "at": "at_a"}), ranks.withColumnsRenamed({"x": "id_b", "at": "at_b"})
    ordered = pairs.select("id_a", "id_b").join(ra, "id_a").join(rb, "id_b")
    first = F.col("at_a") < F.col("at_b")
    turned = cut_lineage(ordered.select(
        F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("before"),
        F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("after"), F.least("at_a", "at_b").alias("at_before")).distinct())
    state = cut_lineage(items.select(F.col(id_col).alias("x"), F.lit("open").alias("status")))
    live = turned
    while state.where("status = 'open'").limit(1).count():
        # Pairs still to be looked at: those whose later item is open.
        live = cut_lineage(live.join(state.where("status = 'open'").select(F.col("x").alias("after")), "after", "left_semi"))
        seen = live.join(state.withColumnRenamed("x", "before"), "before").groupBy(F.col("after").alias("x")).agg(
            F.max(F.col("status") == "leader").alias("led"), F.max(F.col("status") == "open").alias("waiting"))
        led, waiting = F.coalesce("led", F.lit(False)), F.coalesce("waiting", F.lit(False))
        decided = F.when(F.col("status") != "open", F.col("status")).when(led, "follower").when(~waiting, "leader").otherwise("open")
        state = cut_lineage(state.join(seen, "x", "left").select("x", decided.alias("status")))
    leads = state.where("status = 'leader'").select(F.col("x").alias("before"))
    followed = turned.join(leads, "before", "left_semi").groupBy(F.col("after").alias("x")).agg(F.min_by("before", "at_before").alias("leader"))
    final = state.join(followed, "x", "left")
    return final.select(F.col("x").alias(id_col), F.when(F.col("status") == "leader", F.col("x")).otherwise(F.col("leader")).alias("leader"))


def representatives(items: DataFrame, leaders: DataFrame, word: str, id_col: str = "id", order: str = "id") -> DataFrame:
    """(word, representative): the shortest word of each cluster, the first of equals."""
    named = items.join(leaders, id_col)
    best = named.groupBy("leader").agg(F.min_by(word, F.struct(F.length(word), F.col(order))).alias("representative"))
    return named.join(best, "leader").select(word, "representative")
