"""Value flow between addresses: fan-out, funding, next transactions, traces and walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import coin_symbol
from ..sources.shared import dealt, tasks, written
from .windows import first_rows


def own_changes(changes: DataFrame) -> DataFrame:
    """address, digest, own, day: an address's first change in each transaction."""
    return changes.groupBy("address", "digest").agg(F.min(F.struct("ord", "cents"))["cents"].alias("own"), F.first("day").alias("day"))


def meetings(changes: DataFrame, coins: bool = True) -> DataFrame:
    """digest, address, own, day, other, gains, loses, coin: a row for each address of a transaction and each address of
    it, itself included, which gains or loses in it, and, if asked for, a row for each address and each of the coins.

    All are told of one transaction's rows, so changes that are dealt by digest are not shuffled."""
    legs = changes.where("digest is not null").groupBy("digest", "address").agg(
        F.min(F.struct("ord", "cents"))["cents"].alias("own"), F.first("day").alias("day"), F.max(F.col("cents") > 0).alias("gains"), F.max(F.col("cents") < 0).alias("loses"), *([F.collect_set("coin").alias("coins")] if coins else [])
    )
    all_coins = [F.array_distinct(F.flatten(F.collect_list("coins"))).alias("coins")] if coins else []
    tx = legs.groupBy("digest").agg(F.collect_list(F.struct("address", "own", "day", "gains", "loses")).alias("legs"), *all_coins)
    no = lambda t: F.lit(None).cast(t)
    kind = "array<struct<other:string,gains:boolean,loses:boolean,coin:string>>"
    others = F.transform("legs", lambda x: F.struct(x["address"], x["gains"], x["loses"], no("string"))).cast(kind)
    met = F.concat(others, F.transform("coins", lambda x: F.struct(no("string"), no("boolean"), no("boolean"), x)).cast(kind)) if coins else others
    each = tx.select("digest", F.explode("legs").alias("a"), met.alias("met"))
    return each.select("digest", "a.address", "a.own", "a.day", F.explode("met").alias("m")).select("digest", "address", "own", "day", "m.*")


def met_roles() -> tuple[Column, Column, Column]:
    """Tests of a meeting: `other` is a recipient, a sender, or the address itself (a row for each transaction)."""
    away = F.col("other") != F.col("address")
    pays, takes = away & (F.col("own") < 0) & F.col("gains"), away & (F.col("own") > 0) & F.col("loses")
    return F.coalesce(pays, F.lit(False)), F.coalesce(takes, F.lit(False)), F.col("coin").isNull() & F.col("other").eqNullSafe(F.col("address"))


def fanout(changes: DataFrame, latest: int | None = 1000, of: list[str] | None = None, coins: bool = True) -> DataFrame:
    """Distinct recipients, senders and coins of each address over its latest transactions, over all if latest is None.

    The address's own first change in a transaction decides whether the others are recipients (they gain where it
    loses) or senders. Coins count over all changes of the transactions, its own included.

    Only addresses with more than `latest` transactions are ranked; of each, the last one that counts is joined to its
    transactions. Distinct counts take one shuffle by address and other. changes are read several times, so they should
    be a written table, dealt by digest.

    of: a few addresses that are asked for. They are a filter of the scan, and the transactions that are left of
    them, (latest + 1) * len(of) at most, are one of the scan for the others' changes.

    coins: whether coins are counted, which are most of the rows that are counted; coin_type_count is left out otherwise.
    """
    own = changes.where("digest is not null") if of is None else changes.where(F.col("address").isin(of)).where("digest is not null")
    if of is not None:
        asked = own.select("address", "digest", "day")
        if latest is not None:
            asked = written(first_rows(own_changes(own), ["address"], [F.desc("day"), F.desc("digest")], latest + 1).select("address", "digest", "day"), "latest")
            own = asked
        digests = asked.select("digest").distinct()
        changes = changes.join(digests if latest is None else F.broadcast(digests), "digest", "left_semi")
    met = meetings(changes, coins) if of is None else meetings(changes, coins).where(F.col("address").isin(of))
    kept = F.lit(True)
    if latest is not None:
        legs = own.groupBy("address", "digest").agg(F.first("day").alias("day"))
        many = legs.groupBy("address").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > latest).select("address")
        ranked = first_rows(legs.join(many, "address", "left_semi"), ["address"], [F.desc("day"), F.desc("digest")], latest)
        bound = ranked.groupBy("address").agg(F.min(F.struct("day", "digest")).alias("_bound"))  # one row in `latest` at most
        met = met.join(written(bound, "bounds"), "address", "left")
        kept = F.col("_bound").isNull() | (F.struct("day", "digest") >= F.col("_bound"))
    pays, takes, self = met_roles()
    each = met.select("address", "other", "coin", (kept & pays).alias("pays"), (kept & takes).alias("takes"), self.alias("self"), (kept & F.col("coin").isNotNull()).alias("held")).where("pays or takes or self or held")
    # a pair of addresses is one row, whichever of them is asked for: bits 1 and 2 are those of the smaller, 4 and 8 of the other
    pair, turned = F.col("pays") | F.col("takes"), F.col("other") < F.col("address")
    bits = (F.col("pays").cast("int") + 2 * F.col("takes").cast("int")) * F.when(turned, 4).otherwise(1)
    once = each.select(
        F.when(pair & turned, F.col("other")).otherwise(F.col("address")).alias("a"), F.when(pair, F.when(turned, F.col("address")).otherwise(F.col("other"))).alias("b"), F.when(F.col("held"), F.col("coin")).alias("coin"),
        F.when(pair, bits).otherwise(0).alias("bits"), F.col("self").cast("long").alias("n"),
    )
    pairs = once.groupBy("a", "b", "coin").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    side = lambda a, bits, coin, n: F.struct(F.col(a).alias("address"), bits.alias("bits"), coin.alias("coin"), n.alias("n"))
    low, high = side("a", F.col("bits").bitwiseAND(F.lit(3)), F.col("coin"), F.col("n")), side("b", F.shiftright("bits", 2), F.lit(None).cast("string"), F.lit(0).cast("long"))
    sides = pairs.select(F.explode(F.when(F.col("b").isNull(), F.array(low)).otherwise(F.array(low, high))).alias("s")).select("s.*")
    if of is not None:
        sides = sides.where(F.col("address").isin(of))
    has = lambda bit: F.count_if(F.col("bits").bitwiseAND(F.lit(bit)) > 0)
    out = sides.groupBy("address").agg(has(1).alias("recipient_count"), has(2).alias("sender_count"), has(3).alias("counterparty_count"), *([F.count("coin").alias("coin_type_count")] if coins else []), F.sum("n").alias("scanned"))
    most = F.lit(latest).cast("long")
    out = out.withColumn("truncated", F.lit(False) if latest is None else F.col("scanned") > most).withColumn("scanned", F.least("scanned", most))
    r, s, c = F.col("recipient_count"), F.col("sender_count"), F.col("counterparty_count")
    return out.withColumns(
        {
            "out_in_ratio": F.when(s > 0, r / s),
            "flow_shape": F.when(s == 0, "unknown").when(r >= 3 * s, "disperser").when(100 * r <= 33 * s, "collector").otherwise("balanced"),
            "classification": F.when(c >= 1000, "hub").when(c >= 100, "distributor").otherwise("narrow"),
        }
    )


def funded(changes: DataFrame, earliest: int = 12) -> DataFrame:
    """funding_edges with a row for every address: nulls where it has no edge. So one pass tells walks their edges and
    their seeds."""
    # all that is told of a transaction comes from its own rows; then a row for each address in it goes to the address
    tx = ["digest", "day", "sender"]
    net = changes.where("digest is not null").groupBy(*tx, "address", "coin").agg(F.sum("cents").alias("net"), F.min(F.when(F.col("cents") < 0, F.col("cents"))).alias("low"))
    best = net.groupBy(*tx, "address").agg(F.min(F.struct((-F.col("net")).alias("minus"), "coin")).alias("b"), F.min("low").alias("low"))
    lost = F.slice(F.array_sort(F.collect_list(F.when(F.col("low").isNotNull() & F.col("address").isNotNull(), F.struct("low", "address")))), 1, 2)  # of one transaction
    legs = best.groupBy("digest").agg(F.collect_list(F.struct("day", "sender", "address", "b")).alias("legs"), lost.alias("lost")).select("digest", F.explode("legs").alias("a"), "lost").select("digest", "a.*", "lost")
    other = lambda n: F.get("lost", F.lit(n))["address"]
    payer = F.when(F.col("address").isNotNull(), F.when(other(0) != F.col("address"), other(0)).otherwise(other(1)))
    told = legs.select("address", "day", "digest", "b", F.coalesce(payer, "sender", F.lit("unknown")).alias("funder"))
    early = first_rows(told, ["address"], [F.asc("day"), F.asc("digest")], earliest)
    first = early.groupBy("address").agg(F.min(F.when(F.col("b.minus") < 0, F.struct("day", "digest", "b", "funder"))).alias("f")).select("address", "f.*")
    return first.select("address", "digest", "day", F.col("b.coin").alias("coin"), (-F.col("b.minus")).alias("amount_cents"), "funder")


def funding_edges(changes: DataFrame, earliest: int = 12) -> DataFrame:
    """address, digest, day, coin, amount_cents, funder: the first of an address's earliest transactions in which its
    largest net gain of a coin is positive, and who lost most in it (else the sender, else `unknown`)."""
    return funded(changes, earliest).where("digest is not null")


def funding_walks(changes: DataFrame, labels: DataFrame, max_hops: int = 5) -> DataFrame:
    """funding_steps from every address of a transaction, with edges and seeds of one pass over changes."""
    known = written(funded(changes).select("address", "digest", "funder"), "funded")
    return funding_steps(known.where("digest is not null"), labels, known.select("address"), max_hops)


def funding_steps(edges: DataFrame, labels: DataFrame, seeds: DataFrame, max_hops: int = 5) -> DataFrame:
    """Walk every seed (address) back along the edges: address, origin, hops, stop_reason_code, visited.

    After each hop, in this order: an unknown funder, any label, an address seen before (the seed counts) and the
    hop limit stop the walk. Edges, with the funder's label put to them, are one table that every hop joins.
    """
    marked = written(edges.join(labels.select(F.col("address").alias("funder"), F.lit(True).alias("known")), "funder", "left").select(F.col("address").alias("at"), "funder", F.coalesce("known", F.lit(False)).alias("known")), "funding")
    active = seeds.select("address", F.col("address").alias("at"), F.array("address").alias("visited"), F.lit(0).alias("hops"))
    done = []
    for hop in range(1, max_hops + 1):
        met = active.join(marked, "at", "left")
        stop = (
            F.when(F.col("funder").isNull(), "dead_end").when(F.col("funder") == "unknown", "unknown").when(F.col("known"), "labeled")
            .when(F.array_contains("visited", F.coalesce("funder", F.lit(""))), "cycle")
        )
        if hop == max_hops:
            stop = F.coalesce(stop, F.lit("max_hops"))
        moved = F.col("funder").isNotNull()
        step = met.select(
            "address", F.coalesce("funder", "at").alias("at"), F.when(moved, F.array_append("visited", F.col("funder"))).otherwise(F.col("visited")).alias("visited"),
            (F.col("hops") + moved.cast("int")).alias("hops"), stop.alias("stop"),
        )
        step = written(step, f"hop{hop}")
        done.append(step.where("stop is not null"))
        active = step.where("stop is null").drop("stop")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("address", F.col("at").alias("origin"), F.col("hops").cast("long").alias("hops"), F.col("stop").alias("stop_reason_code"), "visited")


def shared_funders(walks: DataFrame) -> DataFrame:
    """funder, address, funded_count: who funded more than one seed, a row for each funded seed."""
    steps = walks.select("address", F.explode(F.slice("visited", 2, F.greatest(F.lit(0), F.size("visited") - 1))).alias("funder")).where("funder <> 'unknown'").distinct()
    counts = steps.groupBy("funder").agg(F.count(F.lit(1)).alias("funded_count")).where("funded_count > 1")
    return steps.join(counts, "funder").select("funder", "address", "funded_count")


def shared_fanout(shared: DataFrame, changes: DataFrame, top: int = 10, latest: int = 300) -> DataFrame:
    """The fan-out of the `top` addresses that funded most seeds, with place and funded_count: whether a common origin is
    one person's or an exchange's.

    Only the top funders' keys reach the driver, and they are a filter of the scan of changes, so the rest of the
    ledger isn't grouped for ten addresses. changes should be a written table.
    """
    counts = shared.select("funder", "funded_count").distinct()
    order = [F.desc("funded_count"), F.asc("funder")]
    best = counts.orderBy(*order).limit(top).collect()
    if not best:
        return fanout(changes.limit(0), latest).withColumn("place", F.lit(0).cast("long")).withColumn("funded_count", F.lit(0).cast("long"))
    place = {r.funder: (i, r.funded_count) for i, r in enumerate(best, 1)}
    at = lambda k: F.element_at(F.create_map(*[F.lit(x) for f, p in place.items() for x in (f, p[k])]), F.col("address")).cast("long")
    return fanout(changes, latest, of=list(place)).withColumn("place", at(0)).withColumn("funded_count", at(1))


def neighbours(changes: DataFrame) -> DataFrame:
    """address, day, next_digest, prev_digest: first transaction of a later day and last one of an earlier day."""
    days = changes.groupBy("address", "day").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    w = W.partitionBy("address").orderBy("day")
    return days.select("address", "day", F.lead("low").over(w).alias("next_digest"), F.lag("high").over(w).alias("prev_digest"))


def trace_edges(tx: DataFrame, changes: DataFrame, swaps: DataFrame, passing: DataFrame) -> DataFrame:
    """digest, day, sender, next_address, next_coin, is_swap, rule: where value goes from each transaction.

    A swap (digest in swaps) stays with the sender, in the coin of their largest gain. Otherwise value goes to the
    first other address that gains and is not passed through (address in passing), else to the first that gains.
    """
    marked = changes.join(passing.select("address", F.lit(True).alias("passes")), "address", "left")
    gains, other = F.col("cents") > 0, ~F.col("address").eqNullSafe(F.col("sender"))
    first = lambda test: F.min(F.when(test, F.struct("ord", "address")))["address"]
    seen = marked.groupBy("digest").agg(
        first(gains & other & F.col("passes").isNull()).alias("recipient"), first(gains & other).alias("pool"),
        F.min(F.when(gains & (F.col("address") == F.col("sender")), F.struct((-F.col("cents")).alias("minus"), "coin")))["coin"].alias("received"),
    )
    met = tx.join(seen, "digest", "left").join(swaps.select("digest", F.lit(True).alias("swapped")), "digest", "left")
    swap = F.coalesce("swapped", F.lit(False)) & F.col("sender").isNotNull()
    rule = F.when(swap, "swap").when(F.col("recipient").isNotNull(), "recipient").when(F.col("pool").isNotNull(), "pool_fallback").otherwise("stop")
    return met.select("digest", "day", "sender", F.when(swap, F.col("sender")).otherwise(F.coalesce("recipient", "pool")).alias("next_address"), F.when(swap, F.col("received")).alias("next_coin"), swap.alias("is_swap"), rule.alias("rule"))


def trace_walk(edges: DataFrame, near: DataFrame, sinks: DataFrame, seeds: DataFrame, directions: tuple[str, ...] = ("forward", "backward"), max_hops: int = 10, carry: tuple[str, ...] = ("sender", "next_address")) -> DataFrame:
    """A row a visited hop: direction, seed, hop, digest, sender, next_address, stop (none, no_next, sink, no_tx, max_hops).

    Every transaction's successor in each direction is worked out once for the whole ledger, in a table dealt by digest;
    all walks, of either direction, then take one equi-join a hop, which moves the walks alone. carry: which of sender
    and next_address the rows have, for each hop writes them.
    """
    at = {d: F.col("next_address" if d == "forward" else "sender") for d in directions}
    steps = edges.select("digest", "sender", "next_address", "day")
    for d in directions:
        onward = near.select(F.col("address").alias("_at"), F.col("day").alias("_day"), F.col("next_digest" if d == "forward" else "prev_digest").alias(f"_{d}"))
        steps = steps.join(onward, (at[d] == F.col("_at")) & (F.col("day") == F.col("_day")), "left").drop("_at", "_day")
        steps = steps.join(sinks.select(F.col("address").alias("_at"), F.lit(True).alias(f"_{d}_sink")), at[d] == F.col("_at"), "left").drop("_at")
    steps = dealt(steps.drop("day"), "steps", "digest", tasks(edges))
    way = lambda of: F.coalesce(*[F.when(F.col("direction") == d, of(d)) for d in directions])
    active, rows = seeds.select(F.explode(F.array(*map(F.lit, directions))).alias("direction"), F.col("digest").alias("seed"), "digest"), []
    for hop in range(1, max_hops + 1):
        last = F.lit("max_hops" if hop == max_hops else "none")
        stop = F.when(F.col("next_address").isNull(), "no_next").when(F.col("sink"), "sink")
        stop = stop.otherwise(last) if hop == max_hops else stop.when(F.col("next_digest").isNull(), "no_tx").otherwise(last)
        met = active.join(steps, "digest").withColumns({"next_address": way(lambda d: at[d]), "next_digest": way(lambda d: F.col(f"_{d}")), "sink": F.coalesce(way(lambda d: F.col(f"_{d}_sink")), F.lit(False))})
        step = met.select("direction", "seed", F.lit(hop).cast("long").alias("hop"), "digest", *carry, "next_digest", stop.alias("stop"))
        step = written(step, "trace")
        rows.append(step.drop("next_digest"))
        active = step.where("stop = 'none'").select("direction", "seed", F.col("next_digest").alias("digest"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def reachable(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """node, level: breadth-first levels over edges (src, dst) from roots (node), to a small depth; no self-edges."""
    seen = written(roots.select("node", F.lit(0).cast("long").alias("level")), "level")
    front = seen
    for level in range(1, depth + 1):
        step = front.join(edges.where("src <> dst"), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = written(step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level).cast("long")), "level")
        seen = seen.unionByName(front)
    return seen


def timeline(tx: DataFrame, changes: DataFrame, tracked: DataFrame, first: Column | None = None, last: Column | None = None, limit: int = 60) -> DataFrame:
    """digest, day, involved: transactions that a tracked address sent or was changed by, in order of day (nulls last).

    Rows without a day are dropped if there is a bound. involved are the tracked addresses touched, sorted.
    """
    touched = tx.select("digest", F.col("sender").alias("address")).unionByName(changes.select("digest", "address")).join(tracked, "address", "left_semi").distinct()
    involved = touched.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("address")), ",").alias("involved"))  # as many as are tracked
    out = tx.select("digest", "day").join(involved, "digest")
    for bound, test in ((first, lambda b: F.col("day") >= b), (last, lambda b: F.col("day") <= b)):
        if bound is not None:
            out = out.where(test(bound))
    return out.orderBy(F.asc_nulls_last("day"), "digest").limit(limit)


def holders(changes: DataFrame, coin: str, supply: Column | None = None, top: int = 20) -> DataFrame:
    """rank, address, balance_cents, object_count, share_ppm of the coin's largest holders; ranks are never shared."""
    held = changes.where((F.col("coin") == coin) & (F.col("cents") > 0))
    sums = held.groupBy("address").agg(F.sum("cents").alias("balance_cents"), F.count(F.lit(1)).alias("object_count"))
    best = sums.orderBy(F.desc("balance_cents"), "address").limit(top)
    rank = F.row_number().over(W.orderBy(F.desc("balance_cents"), "address")).cast("long")  # over the top rows alone
    whole = held.agg(F.sum("cents").alias("whole")) if supply is None else held.agg(F.first(supply).alias("whole"))
    share = F.when(F.col("whole") > 0, F.floor(F.col("balance_cents") * 1_000_000 / F.col("whole")).cast("long"))
    return best.crossJoin(F.broadcast(whole)).select(rank.alias("rank"), "address", "balance_cents", "object_count", share.alias("share_ppm"))


def dominant_inflow(changes: DataFrame) -> DataFrame:
    """digest, inflow_cents: the largest sum of gains of one address, which counts no leg of a swap twice."""
    per = changes.where("cents > 0").groupBy("digest", "address").agg(F.sum("cents").alias("gain"))
    return per.groupBy("digest").agg(F.max("gain").alias("inflow_cents"))


def trace_summary(walk: DataFrame, inflow: DataFrame) -> DataFrame:
    """direction, seed, origin_cents, peak_cents, hops, stop, summary of each walk. Hops are never summed: it is the
    same money that moves on."""
    gained = F.coalesce("inflow_cents", F.lit(0))
    met = walk.join(inflow, "digest", "left").groupBy("direction", "seed").agg(F.min_by(gained, "hop").alias("origin_cents"), F.max(gained).alias("peak_cents"), F.count(F.lit(1)).alias("hops"), F.max_by("stop", "hop").alias("stop"))
    said = F.concat(F.upper("direction"), F.lit(" from "), F.col("seed"), F.lit(": "), F.col("hops"), F.when(F.col("hops") == 1, " hop, ").otherwise(" hops, "), F.col("stop"))
    return met.withColumn("summary", said)


#: Walks of one end that are told together, at most about so many.
TOGETHER = 64


def trace_story(walk: DataFrame, tx: DataFrame, changes: DataFrame, decoded: DataFrame, small: int = 1_000_000, owners: int | None = None) -> DataFrame:
    """direction, seed, story: each walk told hop by hop, with its time, protocols, actions, and who gained or lost what.

    Changes of at most `small` are fees: they are told of only where a hop has no others. What is said of a transaction
    is worked out once, however many walks pass it, and moves once to all walks that end in one transaction, for these
    share most of their hops; of more than TOGETHER such walks, once to each part of them. decoded: digest, protocols
    and actions. owners: tasks that put stories together, those of the session if None.
    """
    big = F.abs("cents") > small
    line = F.concat(F.lit("  "), "address", F.lit(": "), F.col("cents").cast("string"), F.lit(" "), coin_symbol(F.col("coin")))
    ordered = lambda text: F.transform(F.array_sort(F.collect_list(F.when(big, F.struct("ord", text.alias("text"))))), lambda x: x["text"])  # noqa: E731  of one transaction
    told = changes.groupBy("digest").agg(ordered(line).alias("flows"), F.array_distinct(ordered(coin_symbol(F.col("coin")))).alias("coins"))
    said = F.coalesce("actions", F.lit(""))
    flows = F.when(F.size("flows") > 0, F.concat(F.lit("\nFlows:\n"), F.array_join("flows", "\n"))).when(F.col("flows").isNotNull(), "\nFlows:  gas only").otherwise("")
    empty = F.array().cast("array<string>")
    each = tx.join(told, "digest", "left").join(decoded, "digest", "left").select("digest", "day", "sender", flows.alias("flows"), F.coalesce("protocols", F.lit("")).alias("protocols"), F.coalesce("coins", empty).alias("coins"), said.alias("actions"))
    said = each.groupBy("digest").agg(F.collect_list(F.struct("day", "sender", "flows", "protocols", "coins", "actions")).alias("said"))  # one, as a rule
    # ids alone move until walks stand with the others of their end; then each group takes every text that it needs once
    hops = walk.where("digest is not null").groupBy("direction", "seed").agg(F.array_sort(F.collect_list(F.struct("hop", "digest"))).alias("h"))  # ten at most
    ends = hops.withColumn("end", F.element_at("h", -1)["digest"])
    many = ends.groupBy("end").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TOGETHER)
    dealt_to = (F.pmod(F.xxhash64("seed"), F.ceil(F.col("_n") / TOGETHER))).cast("long")
    placed = written(ends.join(many, "end", "left").select("end", F.coalesce(dealt_to, F.lit(0).cast("long")).alias("part"), "direction", "seed", "h"), "hops")
    needed = placed.select("end", "part", F.explode("h.digest").alias("digest")).distinct().join(said, "digest")
    walks, texts = F.struct("direction", "seed", "h"), F.struct("digest", "said")
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("c")).schema["c"].dataType)
    both = placed.select("end", "part", walks.alias("w"), none(needed, texts).alias("t")).unionByName(needed.select("end", "part", none(placed, walks).alias("w"), texts.alias("t")))
    both = both.repartition(*([] if owners is None else [owners]), "end", "part")
    groups = both.groupBy("end", "part").agg(F.collect_list("w").alias("walks"), F.map_from_entries(F.collect_list("t")).alias("texts"))
    found = lambda w, m: F.array_sort(F.flatten(F.transform(w["h"], lambda x: F.transform(F.coalesce(F.try_element_at(m, x["digest"]), F.array().cast(needed.schema["said"].dataType)), lambda s: F.struct(x["hop"].alias("hop"), s["day"], x["digest"].alias("digest"), *[s[c] for c in ("sender", "flows", "protocols", "coins", "actions")])))))
    # the map is a variable of the lambda, so it is made once a group
    met = F.get(F.transform(F.array("texts"), lambda m: F.transform("walks", lambda w: F.struct(w["direction"].alias("direction"), w["seed"].alias("seed"), found(w, m).alias("h")))), F.lit(0))
    walks = groups.select(F.explode(met).alias("w")).select("w.*").where("size(h) > 0")
    body = lambda x: F.concat(F.lit("Tx:     "), x["digest"].cast("string"), F.lit("\nSender: "), F.coalesce(x["sender"], F.lit("unknown")), F.when(x["actions"] != "", F.concat(F.lit("\nAction: "), x["actions"])).otherwise(""), x["flows"])
    names = F.array_distinct(F.filter(F.flatten(F.transform("h", lambda x: F.split(x["protocols"], ","))), lambda x: x != ""))
    first, last, n = F.element_at("h", 1), F.element_at("h", -1), F.size("h").cast("string")
    span = F.abs(last["day"] - first["day"])
    day = lambda d: F.coalesce(F.concat(F.lit("(day "), d.cast("string"), F.lit(") ")), F.lit(""))
    listed = lambda field: F.array_join(F.array_distinct(F.flatten(F.transform("h", lambda x: x[field]))), ", ")
    lead = lambda word, text: F.when(text != "", F.concat(F.lit(f"\n{word}: "), text)).otherwise("")
    story = F.concat(
        F.lit("FUND TRACE — "), F.upper("direction"), F.lit("\nStarting tx: "), first["digest"].cast("string"),
        F.when((F.size("h") > 1) & span.isNotNull(), F.concat(F.lit("\nTime span: "), span.cast("string"), F.when(span == 1, " day").otherwise(" days"), F.lit(" across "), n, F.lit(" hops"))).otherwise(F.concat(F.lit("\nHops: "), n)),
        lead("Protocols", F.array_join(names, ", ")), F.lit("\n"),
        F.array_join(F.transform("h", lambda x: F.concat(F.lit("\n--- Hop "), x["hop"].cast("string"), F.lit(" "), day(x["day"]), F.lit("---\n"), body(x), F.lit("\n"))), ""),
        lead("Coins involved", listed("coins")), lead("Final action", last["actions"]),
    )
    return walks.select("direction", "seed", story.alias("story"))


def hub_suggestions(fanout: DataFrame, labels: DataFrame, classes: tuple[str, ...] = ("hub",)) -> DataFrame:
    """address, category, label, confidence for addresses of these classes that have no label. Only suggested: a label
    decides where traces stop, so a person has to confirm it."""
    rest = fanout.where(F.col("classification").isin(*classes)).join(labels.select("address"), "address", "left_anti")
    label = F.concat(F.lit("Unidentified hub (~"), F.col("recipient_count"), F.lit("+ recipients)"))
    return rest.select("address", F.lit("cex").alias("category"), label.alias("label"), F.lit("low").alias("confidence"))
