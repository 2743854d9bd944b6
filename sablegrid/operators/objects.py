"""Objects: point reads, owned objects, display, names, collections, pools, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import coin_symbol, image_field, package_id, text_field, type_parameters

#: Rows of a page where none are asked for, and at most.
PAGE, PAGE_MOST = 50, 1000


def page_size(limit: int | None) -> int:
    return PAGE if limit is None else max(1, min(limit, PAGE_MOST))


def read(versions: DataFrame, object_id: Column | None = None, version: int | None = None) -> DataFrame:
    """Objects (all, or one) in the given version, or each in its last."""
    if object_id is not None:
        versions = versions.where(F.col("object_id") == object_id)
    if version is not None:
        return versions.where(F.col("version") == version)
    rest = F.struct(*[c for c in versions.columns if c not in ("object_id", "version")])
    return versions.groupBy("object_id").agg(F.max("version").alias("version"), F.max_by(rest, "version").alias("o")).select("object_id", "version", "o.*")


def display(objects: DataFrame) -> DataFrame:
    """object_id, name, description, image_url: of the rendered display first, then of the raw content."""
    pick = lambda field: F.coalesce(text_field(F.col("display"), field), text_field(F.col("content"), field)).alias(field)
    image = F.coalesce(image_field(F.col("display")), image_field(F.col("content"))).alias("image_url")
    return objects.select("object_id", pick("name"), pick("description"), image)


def owned(objects: DataFrame, owner: str, type: str | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
    """A page of an owner's objects by id, of one type or of all."""
    rows = objects.where(F.col("owner") == owner)
    if type is not None:
        rows = rows.where(F.startswith("type", F.lit(type)))
    if after is not None:
        rows = rows.where(F.col("object_id") > after)
    return rows.orderBy("object_id").limit(page_size(limit))


def names_of(asked: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """asked (key) with the name service's value; unknown ones keep a null and stop nothing. Works both ways."""
    known = names.groupBy(key).agg(F.min(value).alias(value))
    return asked.join(known, key, "left").select(key, value, F.col(value).isNotNull().alias("found"))


def registered(types: DataFrame) -> DataFrame:
    """type, slug, name of collections known by their type alone: the module in lower case, the struct's name."""
    parts = F.split("type", "::")
    slug = F.when(F.size(parts) >= 2, F.regexp_replace(F.lower(F.element_at(parts, -2)), "_", "-")).otherwise(F.lower("type"))
    return types.select("type").distinct().select("type", slug.alias("slug"), F.element_at(parts, -1).alias("name"))


def collections_of(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """asked (term) with the collection's type: equal slug first, else a slug or name that contains the term; the least
    type of several. Terms without an equal slug meet the distinct collections, of which there are few."""
    term = F.lower("term")
    slugs = registry.groupBy("slug").agg(F.min("type").alias("exact"))
    met = asked.join(slugs, term == F.col("slug"), "left").select("term", "exact")
    rest = met.where("exact is null").select("term").distinct()
    like = rest.join(registry, F.contains("slug", term) | F.contains(F.lower("name"), term)).groupBy("term").agg(F.min("type").alias("like"))
    return met.join(like, "term", "left").select("term", F.coalesce("exact", "like").alias("type"))


def feeds_of(coins: DataFrame, feeds: DataFrame) -> DataFrame:
    """coin, symbol, feed_id: the price feed of each coin's symbol; an exact pair with USD first, else the least id."""
    symbol = F.upper("symbol")
    own = feeds.select(F.col("feed_id"), F.upper("base").alias("base"), F.upper("feed_symbol").alias("feed_symbol"), F.upper("quote").alias("quote"))
    asked = coins.select("coin", coin_symbol(F.col("coin")).alias("symbol"))
    found = asked.select(symbol.alias("base")).distinct().join(own, "base")
    exact = (F.col("feed_symbol") == F.concat(F.lit("CRYPTO."), F.col("base"), F.lit("/USD"))) | (F.col("quote") == "USD")
    best = found.groupBy("base").agg(F.min(F.struct((~exact).alias("worse"), "feed_id"))["feed_id"].alias("feed_id"))
    return asked.join(best, symbol == F.col("base"), "left").select("coin", "symbol", "feed_id")


def kiosks(caps: DataFrame) -> DataFrame:
    """owner, kiosk: shops that an owner holds a cap for, in either of the two ways of holding one, each once."""
    plain = caps.where("kind = 'standard'").select("owner", text_field(F.col("content"), "for").alias("kiosk"))
    wrapped = caps.where("kind = 'personal'").select("owner", text_field(F.col("content"), "cap.for").alias("kiosk"))
    return plain.unionByName(wrapped).where("kiosk is not null").distinct()


def pools(objects: DataFrame, protocols: DataFrame) -> DataFrame:
    """object_id, protocol, protocol_type, token_a, token_b, reserve_a, reserve_b, fee of pool objects.

    Reserves are a pool's balances; an order book reports none, for what its vaults hold can't all be traded against.
    """
    at = lambda *fields: F.coalesce(*[F.get_json_object("content", "$." + f) for f in fields])
    rows = objects.where(F.contains(F.lower("type"), F.lit("pool"))).withColumn("package", package_id(F.col("type")))
    rows = rows.join(F.broadcast(protocols), "package", "left").withColumn("params", type_parameters(F.col("type")))
    book = F.col("protocol_type") == "clob"
    reserve = lambda side: F.when(~F.coalesce(book, F.lit(False)), at(f"coin_{side}", f"balance_{side}"))
    return rows.select(
        "object_id", "protocol", F.coalesce("protocol_type", F.lit("dex")).alias("protocol_type"), F.get("params", 0).alias("token_a"), F.get("params", 1).alias("token_b"),
        reserve("a").alias("reserve_a"), reserve("b").alias("reserve_b"), F.when(book, at("taker_fee")).otherwise(at("fee_rate", "fee")).alias("fee"),
    )


#: Where lending protocols keep their entries: kind, side, list, fields of the asset and of the amount.
POSITIONS = (
    ("suilend", "supply", "deposits", ("coin_type", "deposit_reserve"), ("deposited_ctoken_amount",)),
    ("suilend", "borrow", "borrows", ("coin_type", "borrow_reserve"), ("borrowed_amount",)),
    ("navi", "supply", "supplies", ("coin_type", "asset"), ("amount", "balance")),
    ("navi", "borrow", "borrows", ("coin_type", "asset"), ("amount", "balance")),
    ("scallop", "supply", "collaterals", ("type", "asset"), ("amount",)),
    ("scallop", "borrow", "debts", ("type", "asset"), ("amount",)),
)
#: Protocols whose object is one position: kind, field of the asset, fields of the amount.
SINGLE_POSITIONS = (("cetus", "pool", "liquidity"), ("bluefin", "pool", "liquidity"), ("staked", "pool_id", "principal"), ("bucket", None, "collateral_amount"))


def positions(objects: DataFrame) -> DataFrame:
    """object_id, protocol, side, asset, amount: a row for each entry of the objects (object_id, protocol, content)."""
    first = lambda text, fields: F.coalesce(*[F.get_json_object(text, "$." + f) for f in fields])
    out = []
    for kind, side, place, asset, amount in POSITIONS:
        entries = F.from_json(F.get_json_object("content", "$." + place), "array<string>")
        rows = objects.where(F.col("protocol") == kind).select("object_id", "protocol", F.explode(entries).alias("e"))
        out.append(rows.select("object_id", "protocol", F.lit(side).alias("side"), first(F.col("e"), asset).alias("asset"), first(F.col("e"), amount).alias("amount")))
    for kind, asset, amount in SINGLE_POSITIONS:
        own = first(F.col("content"), (asset,)) if asset else F.lit(None).cast("string")
        out.append(objects.where(F.col("protocol") == kind).select("object_id", "protocol", F.lit("single").alias("side"), own.alias("asset"), first(F.col("content"), (amount,)).alias("amount")))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole


def metadata(objects: DataFrame, wrapper: str) -> DataFrame:
    """object_id, coin, name, version of the objects of a type with one parameter (`wrapper<coin>`): the catalogue's rows.
    The name is null where the content has none that is text."""
    rows = objects.where(F.startswith("type", F.lit(f"{wrapper}<")))
    coin = F.substring(F.col("type"), F.lit(len(wrapper) + 2), F.length("type") - len(wrapper) - 2)
    return rows.select("object_id", coin.alias("coin"), text_field(F.col("content"), "name").alias("name"), "version")


def capped_merge(rows: DataFrame, key: str, order: list[Column], per_key: int, limit: int) -> DataFrame:
    """The first rows of each key, then the first of all."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= per_key).drop("_n").orderBy(*order).limit(limit)


def within_budget(rows: DataFrame, keys: list[str], order: list[Column], size: str, most: int, band: Column) -> DataFrame:
    """Rows in order until their sizes (not negative) pass the budget; the row that passes it is out.

    band is a whole number that never falls in the order. A band starts at the sum of those before it, bands that start
    above the budget are dropped before any row is sorted, and each other one is sorted apart; so a key that holds most
    rows is many tasks.
    """
    cut = rows.withColumn("_band", band)
    sums = cut.groupBy(*keys, "_band").agg(F.sum(size).alias("_sum"))
    so_far = F.sum("_sum").over(W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, 0))
    starts = sums.select(*keys, "_band", (so_far - F.col("_sum")).alias("_start")).where(F.col("_start") <= most)
    own = F.sum(size).over(W.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return cut.join(starts, [*keys, "_band"]).withColumn("used", own + F.col("_start")).where(F.col("used") <= most).drop("_band", "_start")
