"""Scans, lookups, ranked name matching and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def scan_events(events: DataFrame, type: str | None = None, sender: object = None, after: int | None = None, before: int | None = None, limit: int | None = None) -> DataFrame:
    """Events by type, sender and checkpoint bounds (both exclusive); a limit takes the first by seq."""
    for given, test in ((type, F.col("type") == type), (sender, F.col("sender") == F.lit(sender)), (after, F.col("seq") > F.lit(after)), (before, F.col("seq") < F.lit(before))):
        if given is not None:
            events = events.where(test)
    return events if limit is None else events.orderBy("seq").limit(limit)


def scan_transactions(tx: DataFrame, changes: DataFrame, commands: DataFrame, sender: str | None = None, affected: str | None = None, function: str | None = None, after: int | None = None, before: int | None = None, object_id: str | None = None, objects: DataFrame | None = None) -> DataFrame:
    """Transactions by sender, day bounds and at most one of an affected address, an affected object and a function.
    objects: digest, object_id of what each transaction touched."""
    given = [n for n, x in (("affected", affected), ("object_id", object_id), ("function", function)) if x is not None]
    if len(given) > 1:
        raise ValueError(f"{' and '.join(given)} exclude each other")
    if sender is not None:
        tx = tx.where(F.col("sender") == sender)
    if after is not None:
        tx = tx.where(F.col("day") > after)
    if before is not None:
        tx = tx.where(F.col("day") < before)
    if affected is not None:
        tx = tx.join(changes.where(F.col("address") == affected).select("digest"), "digest", "left_semi")
    if object_id is not None:
        if objects is None:
            raise ValueError("object_id needs the objects that transactions touched")
        tx = tx.join(objects.where(F.col("object_id") == object_id).select("digest"), "digest", "left_semi")
    if function is not None:
        package, module, name = [*function.split("::"), None, None][:3]
        calls = commands.where(F.col("package") == package)
        for column, part in (("module", module), ("function", name)):
            if part:
                calls = calls.where(F.col(column) == part)
        tx = tx.join(calls.select("digest"), "digest", "left_semi")
    return tx


def sponsored(tx: DataFrame) -> DataFrame:
    """tx (sender, sponsor) with gas_sponsored: whether someone else paid for it."""
    return tx.withColumn("gas_sponsored", F.coalesce(F.col("sponsor") != F.col("sender"), F.col("sponsor").isNotNull()))


def keyset_page(rows: DataFrame, key: str, after: object, limit: int) -> DataFrame:
    """The rows after a key, in its order."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def resolve_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (term) with the best match among names (id, name): equal without case, else one that contains the term.

    Equal names come from an equi-join; terms without one are matched by substring against the distinct names that
    have the term's first three letters in them. Only terms of one or two letters meet all names.
    """
    low = names.groupBy(F.lower("name").alias("low")).agg(F.min(F.struct("id", "name")).alias("best"))
    equal = asked.join(low, F.lower("term") == F.col("low"), "left").select("term", F.col("best.id").alias("id"), F.col("best.name").alias("name"), F.when(F.col("best").isNotNull(), F.lit(0)).alias("rank"))
    rest = equal.where("rank is null").select("term")
    term, three = F.lower("term"), lambda c, at: F.substr(c, at, F.lit(3))
    within = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda at: three(F.col("low"), at)))
    threes = low.where(F.length("low") >= 3).select("low", "best", F.explode(within).alias("three"))
    asked_once = rest.distinct()
    longer = asked_once.where(F.length(term) >= 3).withColumn("three", three(term, F.lit(1))).join(threes, "three").where(F.contains("low", term))
    shorter = asked_once.where(F.length(term) < 3).join(low, F.contains("low", term))
    part = longer.select("term", "best").unionByName(shorter.select("term", "best")).groupBy("term").agg(F.min(F.struct("best.name", "best.id")).alias("b"))
    found = rest.join(part, "term", "left").select("term", F.col("b.id").alias("id"), F.col("b.name").alias("name"), F.when(F.col("b").isNotNull(), F.lit(1)).alias("rank"))
    return equal.where("rank is not null").unionByName(found)


def resolve_tokens(asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """asked (term) with the token's type and how it was found: literal (a type's own text has `::`), symbol (equal without
    case, the least type of several) or part (the first name, then symbol, that contains the term); nulls if none does.

    tokens: type, symbol, name. Only terms that are no literal look anything up; a symbol is one equi-join, and parts are
    found by three letters of the term as in resolve_names.
    """
    literal = asked.where(F.contains("term", F.lit("::"))).select("term", F.col("term").alias("type"), F.lit("literal").alias("found"))
    rest = asked.where(~F.contains("term", F.lit("::")))
    symbols = tokens.where("symbol is not null").groupBy(F.lower("symbol").alias("low")).agg(F.min("type").alias("type"))
    equal = rest.join(symbols, F.lower("term") == F.col("low"), "left").select("term", "type", F.when(F.col("type").isNotNull(), F.lit("symbol")).alias("found"))
    # a token's name comes before its symbol
    words = tokens.select(F.col("type"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("name").alias("word")), F.struct(F.lit(1).alias("kind"), F.col("symbol").alias("word")))).alias("w"))
    open_ = equal.where("found is null").select("term")
    met = [resolve_names(open_.distinct(), words.where(F.col("w.kind") == k).select(F.col("type").alias("id"), F.col("w.word").alias("name"))).select("term", F.col("id").alias(f"t{k}")) for k in (0, 1)]
    part = open_.join(met[0], "term", "left").join(met[1], "term", "left").withColumn("type", F.coalesce("t0", "t1"))
    part = part.select("term", "type", F.when(F.col("type").isNotNull(), F.lit("part")).alias("found"))
    return literal.unionByName(equal.where("found is not null")).unionByName(part)


def parsed_name(path: Column) -> tuple[Column, Column, Column, Column]:
    """Name, version (null: the latest), module and type of `@org/app[/version][::module::type]`."""
    parts = F.split(path, "::")
    whole = F.get(parts, F.lit(0))
    pinned = F.regexp_extract(whole, "^(.+/.+)/([0-9]+)$", 2)
    name = F.when(pinned != "", F.regexp_extract(whole, "^(.+/.+)/([0-9]+)$", 1)).otherwise(whole)
    return name, F.nullif(pinned, F.lit("")).cast("long"), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))


def package_info(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """asked (name, a version may be pinned) with the registry's record: version, package, description; nulls if there is none.

    registry: name, version, package, description, a row for each version; without a pin the latest counts.
    """
    name, pin, _, _ = parsed_name(F.col("name"))
    want = asked.select("name", name.alias("_name"), pin.alias("_pin"))
    last = registry.groupBy(F.col("name").alias("_name")).agg(F.max("version").alias("_last"))
    want = want.join(last, "_name", "left").withColumn("version", F.coalesce("_pin", "_last"))
    own = registry.withColumnRenamed("name", "_name")
    return want.join(own, ["_name", "version"], "left").select("name", F.when(F.col("package").isNotNull(), F.col("version")).alias("version"), "package", "description")


def resolve_structs(asked: DataFrame, registry: DataFrame, structs: DataFrame) -> DataFrame:
    """asked (path, `@org/app[/version]::module::type`) with type_tag: the type under the package that defined it, null if
    the name or the type is missing.

    structs: package, module, type, defined_in (the package of the version that brought the type).
    """
    name, pin, module, kind = parsed_name(F.col("path"))
    want = asked.select("path", F.concat_ws("/", name, pin.cast("string")).alias("name"), module.alias("module"), kind.alias("type"))
    found = package_info(want.select("name").distinct(), registry).select("name", "package")
    met = want.join(found, "name", "left").join(structs, ["package", "module", "type"], "left")
    return met.select("path", F.when(F.col("defined_in").isNotNull(), F.concat_ws("::", "defined_in", "module", "type")).alias("type_tag"))


def hot_then_cold(hot: DataFrame, cold: DataFrame, key: str) -> DataFrame:
    """Rows of the recent store, and those of the archive that it lacks."""
    return hot.unionByName(cold.join(hot.select(key), key, "left_anti"))


def likely_collectible(type_name: Column, excluded: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for part in excluded:
        out = out & ~F.contains(type_name, F.lit(part))
    return out


def identify(ids: DataFrame, cascade: list[tuple[str, DataFrame]]) -> DataFrame:
    """ids (id) with the first kind of the cascade whose table (id) holds it, else wallet."""
    kinds = [t.select("id", F.lit(n).alias("n")) for n, (_, t) in enumerate(cascade)]
    whole = kinds[0]
    for k in kinds[1:]:
        whole = whole.unionByName(k)
    first = whole.groupBy("id").agg(F.min("n").alias("n"))
    names = F.array(*[F.lit(name) for name, _ in cascade])
    return ids.join(first, "id", "left").select("id", F.when(F.col("n").isNull(), F.lit("wallet")).otherwise(F.element_at(names, (F.coalesce("n", F.lit(0)) + 1).cast("int"))).alias("kind"))


def precedence(layers: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, of the layer that comes first."""
    return layers.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def merge_prices(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Price of the first source, else of the second; a negative price is unknown. source joins the names of those that know it."""
    good = lambda df, name: df.select(key, F.when(F.col("price") >= 0, F.col("price")).alias(name))
    both = good(first, "a").join(good(second, "b"), key, "full")
    source = F.concat_ws("+", F.when(F.col("a").isNotNull(), F.lit("a")), F.when(F.col("b").isNotNull(), F.lit("b")))
    return both.select(key, F.coalesce("a", "b").alias("price"), source.alias("source"))


def activity_since(rows: DataFrame, mark: Column, since: object) -> DataFrame:
    """Rows after a high-water mark; rows without one are kept, for nothing shows that they are old."""
    return rows.where(mark.isNull() | (mark > F.lit(since)))


def fresh(cache: DataFrame, now: Column, ttl_seconds: int, method: int) -> DataFrame:
    """Cached rows of the present method that are not older than the time they may live."""
    return cache.where((F.col("method_version") == method) & (F.col("measured_at") >= now - ttl_seconds))
