"""Clusters of subreads as rounds of joins: expectation maximisation over allele profiles, and communities of a network.

All take the columns of `by` (sample, parameter set), and work on every group of them at once: a round is the same few joins however
many groups there are, and its tables are checkpointed. Groups that have settled have no rows in later rounds' moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.operators.graph import _settled

PLACES = 9  # to which log-likelihoods are rounded before they are compared, so that the order of a sum decides nothing
GAIN = 1e-12  # by which a move must raise the modularity


def _best(scores):
    """Index of the first greatest value of an array."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _likelihoods(observed: DataFrame, profiles: DataFrame, by: list[str]) -> DataFrame:
    """by, id, n (markers seen), ll: log-likelihood of each subread under each state's profile, an array in the order of states."""
    each = observed.join(profiles, [*by, "marker", "allele"]).groupBy(*by, "id", "state").agg(F.round(F.sum(F.log(F.greatest("p", F.lit(1e-4)))), PLACES).alias("l"), F.count(F.lit(1)).alias("n"))
    per = each.groupBy(*by, "id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("state", "l"))).alias("ls"))
    return per.select(*by, "id", "n", F.transform("ls", lambda x: x["l"]).alias("ll"))


def _dealt(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, id, state: subreads in turn, those with most markers first, each to its likeliest state, less so the fuller the state is.

    A state's room is the number of subreads over that of states; the prior is log(1 - size / room), and log(1e-8) for a full one. The turn is a
    fold over the subreads of one group, whose number is the coverage of one locus in one sample.
    """
    turn = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "id", "ll")))
    groups = scored.groupBy(*by).agg(turn.alias("turn"), F.first(F.size("ll")).alias("states"))
    room = F.size("turn") / F.col("states")
    prior = lambda size: F.when(size < room, F.log(1 - size / room)).otherwise(F.log(F.lit(1e-8)))

    def deal(acc, x):
        state = _best(F.zip_with(x["ll"], acc["sizes"], lambda l, size: l + prior(size)))  # noqa: E741
        grown = F.transform(acc["sizes"], lambda size, k: F.when(k == state, size + 1).otherwise(size))
        return F.struct(grown.alias("sizes"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), state.alias("state")))).alias("out"))

    empty = F.struct(F.transform(F.sequence(F.lit(1), F.col("states")), lambda _: F.lit(0)).alias("sizes"), F.expr("cast(array() as array<struct<id: string, state: int>>)").alias("out"))
    out = groups.select(*by, F.explode(F.aggregate("turn", empty, deal)["out"]).alias("o"))
    return out.select(*by, "o.id", "o.state")


def em(observed: DataFrame, states: int | str, by: list[str] | None = None, rounds: int = 10) -> DataFrame:
    """by, id, cluster, confidence of observations (by, id, marker, allele): allele profiles of `states` states, fitted in rounds.

    states is a number, or a column that holds it for each group. All profiles begin with even shares. In a round subreads are dealt to states
    in turn (see _dealt), and a state takes the shares of the alleles its subreads hold, kept within a margin of 0.2 of certainty, and of 0.1
    in a last round. At the end each subread goes to the likeliest profile without a prior; its confidence is the distance to the second best.
    """
    by = by or []
    most = F.col(states) if isinstance(states, str) else F.lit(states)
    observed = _settled(observed.select(*by, F.col("id").cast("string").alias("id"), "marker", "allele", most.cast("int").alias("_states")))
    alleles = observed.groupBy(*by, "marker", "allele").agg(F.first("_states").alias("_states"))
    even = 1 / F.count(F.lit(1)).over(Window.partitionBy(*by, "marker"))
    alleles = alleles.withColumn("p", even)  # before there is a row for each state
    profiles = _settled(alleles.select(*by, "marker", "allele", F.explode(F.sequence(F.lit(0), F.col("_states") - 1)).alias("state"), "p"))
    observed = observed.drop("_states")
    for margin in [0.2] * rounds + [0.1]:
        dealt = _dealt(_likelihoods(observed, profiles, by), by)
        seen = observed.join(dealt, [*by, "id"]).groupBy(*by, "marker", "allele", "state").agg(F.count(F.lit(1)).alias("k"))
        share = F.col("k") / F.sum("k").over(Window.partitionBy(*by, "marker", "state"))
        seen = seen.select(*by, "marker", "allele", "state", F.least(F.greatest(share, F.lit(margin)), F.lit(1 - margin)).alias("new"))
        profiles = _settled(profiles.join(seen, [*by, "marker", "allele", "state"], "left").withColumn("p", F.coalesce("new", "p")).drop("new"))
    ll = F.sort_array("ll", asc=False)
    sure = F.when(F.size("ll") > 1, F.get(ll, F.lit(0)) - F.get(ll, F.lit(1))).otherwise(1.0)
    return _settled(_likelihoods(observed, profiles, by).select(*by, "id", _best(F.col("ll")).alias("cluster"), sure.alias("confidence")))


def _modularity(ways: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """by, q: the modularity of a state (by, node, community, degree, loop, total), times the total weight."""
    of = state.select(*by, "node", "community")
    a, b = of.withColumnsRenamed({"node": "a", "community": "ca"}), of.withColumnsRenamed({"node": "b", "community": "cb"})
    inner = ways.join(a, [*by, "a"]).join(b, [*by, "b"]).filter("ca = cb").groupBy(*by, F.col("ca").alias("community")).agg(F.sum("w").alias("w"))
    own = state.groupBy(*by, "community").agg(F.sum("degree").alias("v"), F.sum("loop").alias("l"), F.first("total").alias("t"))
    q = F.coalesce("w", F.lit(0.0)) + 2 * F.col("l") - F.col("v") * F.col("v") / F.col("t")
    return own.join(inner, [*by, "community"], "left").groupBy(*by).agg(F.sum(q).alias("q"))


def _proposals(ways: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """by, node, here, there, gain, alone (both are communities of one): moves to the neighbouring community of the greatest gain, ties to the least name."""
    of = state.select(*by, F.col("node").alias("b"), "community")
    links = ways.join(of, [*by, "b"]).groupBy(*by, F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
    links = links.unionByName(state.select(*by, "node", "community", F.lit(0.0).alias("w"))).groupBy(*by, "node", "community").agg(F.sum("w").alias("w"))
    size = state.groupBy(*by, "community").agg(F.sum("degree").alias("volume"), F.count(F.lit(1)).alias("members"))
    rows = links.join(size, [*by, "community"]).join(state.select(*by, "node", F.col("community").alias("here"), "degree", "total"), [*by, "node"])
    own = F.col("community") == F.col("here")
    value = F.round(F.col("w") - (F.col("volume") - F.when(own, F.col("degree")).otherwise(0.0)) * F.col("degree") / F.col("total"), 12)
    rows = rows.withColumn("value", value)
    best = rows.groupBy(*by, "node", "here").agg(
        F.min(F.struct((-F.col("value")).alias("v"), F.col("community").alias("there"), "members")).alias("best"), F.max(F.when(own, F.col("value"))).alias("stay"), F.max(F.when(own, F.col("members"))).alias("own")
    )
    gain = -F.col("best.v") - F.col("stay")
    alone = (F.col("own") == 1) & (F.col("best.members") == 1)
    return best.select(*by, "node", "here", F.col("best.there").alias("there"), gain.alias("gain"), alone.alias("alone")).filter((F.col("there") != F.col("here")) & (F.col("gain") > GAIN))


def _many(moves: DataFrame, by: list[str]) -> DataFrame:
    """Moves from communities that rather give to communities that rather take; of two single nodes the greater moves."""
    moves = moves.filter("not alone or there < here")
    gives = moves.groupBy(*by, F.col("here").alias("c")).agg(F.max("gain").alias("gives"))
    takes = moves.groupBy(*by, F.col("there").alias("c")).agg(F.max("gain").alias("takes"))
    taker = takes.join(gives, [*by, "c"], "left").filter("gives is null or takes >= gives").select(*by, "c")
    return moves.join(taker.withColumnRenamed("c", "there"), [*by, "there"], "left_semi").join(taker.withColumnRenamed("c", "here"), [*by, "here"], "left_anti")


def _apart(moves: DataFrame, by: list[str]) -> DataFrame:
    """Moves that are the best of all that touch either of their communities: none of them changes what another gains."""
    rank = F.struct((-F.col("gain")).alias("g"), "node")
    first = moves.select(*by, F.explode(F.array("here", "there")).alias("c"), rank.alias("rank")).groupBy(*by, "c").agg(F.min("rank").alias("first"))
    both = moves.withColumn("rank", rank)
    for end in ("here", "there"):
        both = both.join(first.withColumnsRenamed({"c": end, "first": f"first_{end}"}), [*by, end])
    return both.filter("rank = first_here and rank = first_there").select(moves.columns)


def _moved(state: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    to = moves.select(*by, "node", "there")
    return state.join(to, [*by, "node"], "left").withColumn("community", F.coalesce("there", "community")).drop("there")


def communities(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, node, community (its least node) of undirected weighted edges (by, a, b, weight), each pair once, without loops.

    Nodes move to the neighbouring community of the greatest gain in modularity until none gains; then communities become nodes, and again. In a
    round all groups of `by` take part, and many nodes move at once; where that does not raise a group's modularity, only moves that do not touch
    each other are made, of which each gains what it promised. So modularity rises in every round, and the rounds end. Ties go to the least names.
    """
    by = by or []
    pair = edges.select(*by, F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("weight").cast("double").alias("w"))
    ways = _settled(pair.unionByName(pair.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy(*by, "a", "b").agg(F.sum("w").alias("w")))
    member = ways.select(*by, F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    loops = member.select(*by, "node", F.lit(0.0).alias("loop"))
    while True:
        degree = loops.join(ways.groupBy(*by, F.col("a").alias("node")).agg(F.sum("w").alias("out")), [*by, "node"], "left").select(*by, "node", "loop", (F.coalesce("out", F.lit(0.0)) + 2 * F.col("loop")).alias("degree"))
        total = degree.groupBy(*by).agg(F.sum("degree").alias("total")).filter("total > 0")
        state = degree.join(total, by) if by else degree.crossJoin(F.broadcast(total))  # one row
        state, moved = _settled(state.withColumn("community", F.col("node"))), False
        while True:
            moves = _settled(_proposals(ways, state, by))
            if moves.isEmpty():
                break
            moved = True
            many = _settled(_many(moves, by))
            now, then = _modularity(ways, state, by), _modularity(ways, _moved(state, many, by), by).withColumnRenamed("q", "later")
            worth = (now.join(then, by) if by else now.crossJoin(F.broadcast(then))).filter(F.col("later") > F.col("q") + GAIN)  # one row a group
            if by:
                worth = _settled(worth.select(*by))
                chosen = many.join(worth, by, "left_semi").unionByName(_apart(moves, by).join(worth, by, "left_anti"))
            else:
                chosen = _apart(moves, by) if worth.isEmpty() else many
            state = _settled(_moved(state, chosen, by))
        if not moved:
            break
        of = state.select(*by, "node", "community")
        member = _settled(member.withColumnRenamed("community", "mid").join(of.withColumnsRenamed({"node": "mid", "community": "to"}), [*by, "mid"]).select(*by, "node", F.col("to").alias("community")))
        a, b = of.withColumnsRenamed({"node": "a", "community": "ca"}), of.withColumnsRenamed({"node": "b", "community": "cb"})
        merged = _settled(ways.join(a, [*by, "a"]).join(b, [*by, "b"]).groupBy(*by, "ca", "cb").agg(F.sum("w").alias("w")))
        inner = merged.filter("ca = cb").select(*by, F.col("ca").alias("community"), (F.col("w") / 2).alias("inner"))
        loops = state.groupBy(*by, "community").agg(F.sum("loop").alias("loop")).join(inner, [*by, "community"], "left").select(*by, F.col("community").alias("node"), (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop"))
        loops, ways = _settled(loops), merged.filter("ca <> cb").select(*by, F.col("ca").alias("a"), F.col("cb").alias("b"), "w")
    least = member.groupBy(*by, "community").agg(F.min("node").alias("least"))
    return member.join(least, [*by, "community"]).select(*by, "node", F.col("least").alias("community"))
