"""Column expressions for addresses, amounts, coin names and payload paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals of coins by symbol; all others have DEFAULT_DECIMALS.
DECIMALS = {"SUI": 9, "USDC": 6, "USDT": 6, "DEEP": 6, "CETUS": 9, "NS": 6, "WAL": 9, "BUCK": 9, "NAVX": 9, "SCA": 9, "BLUE": 9, "WETH": 8, "WBTC": 8, "IKA": 9, "UP": 6}
DEFAULT_DECIMALS = 9
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def normalize_address(a: Column) -> Column:
    """Trimmed, lower case, 32 bytes in hex."""
    return F.concat(F.lit("0x"), F.lpad(F.regexp_replace(F.lower(F.trim(a)), "^0x", ""), 64, "0"))


def coin_symbol(coin: Column) -> Column:
    """Last of three or more parts of a type name, else the name itself."""
    parts = F.split(coin, "::")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(coin)


def coin_decimals(coin: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DECIMALS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, coin_symbol(coin)), F.lit(DEFAULT_DECIMALS))


def human_amount(raw: Column, decimals: Column) -> Column:
    return F.abs(raw).cast("double") / F.pow(F.lit(10.0), decimals)


def usd_value(raw: Column, decimals: Column, price: Column) -> Column:
    """Zero where the price is unknown or not finite."""
    good = price.isNotNull() & ~F.isnan(price) & (F.abs(price) != float("inf"))
    return F.when(good, human_amount(raw, decimals) * price).otherwise(F.lit(0.0))


def format_usd(value: Column) -> Column:
    size = F.abs(value)
    return (
        F.when(size == 0, F.lit("$0")).when(size < 0.01, F.lit("<$0.01")).when(size < 1e3, F.concat(F.lit("$"), F.format_string("%.2f", value)))
        .when(size < 1e6, F.concat(F.lit("$"), F.format_string("%.1f", value / 1e3), F.lit("K"))).when(size < 1e9, F.concat(F.lit("$"), F.format_string("%.1f", value / 1e6), F.lit("M")))
        .otherwise(F.concat(F.lit("$"), F.format_string("%.1f", value / 1e9), F.lit("B")))
    )


def format_amount(raw: Column, decimals: int | None) -> Column:
    """Signed exact decimal text without trailing zeros; raw where the decimals are unknown."""
    if decimals is None:
        return raw.cast("string")
    if decimals == 0:
        return raw.cast("string")
    digits = F.regexp_replace(raw.cast("string"), "^-", "")
    wide = F.lpad(digits, F.greatest(F.length(digits), F.lit(decimals + 1)), "0")
    text = F.concat(F.substr(wide, F.lit(1), F.length(wide) - decimals), F.lit("."), F.substr(wide, F.length(wide) - decimals + 1))
    return F.concat(F.when(raw < 0, F.lit("-")).otherwise(F.lit("")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""))


def format_duration(seconds: Column) -> Column:
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
    part = lambda s, name: unit(F.floor(seconds / s + 0.5).cast("long"), name)
    return F.when(seconds < 60, F.lit("<1 minute")).when(seconds < 3600, part(60, "minute")).when(seconds < 86400, part(3600, "hour")).otherwise(part(86400, "day"))


def oracle_price(price: Column, expo: Column) -> Column:
    return price.cast("double") * F.pow(F.lit(10.0), expo)


def numeric_path(payload: Column, path: str) -> Column:
    """Number at a dotted path of JSON text: a finite number, or a string that reads as one; else null.

    Booleans, null, objects, arrays, NaN and infinities are null, as is text that only some readers take for a number.
    """
    at = F.get_json_object(payload, "$." + path)
    kind = F.try_variant_get(F.try_parse_json(payload), "$." + path, "variant")
    plain = ~F.coalesce(F.schema_of_variant(kind).rlike("^(BOOLEAN|OBJECT|ARRAY|VOID)"), F.lit(True))
    value = F.when(plain & at.rlike(NUMBER), F.trim(at).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def owner_text(kind: Column, address: Column) -> Column:
    return F.when(kind.isin("address", "object") & address.isNotNull(), F.concat_ws(":", kind, address)).otherwise(kind)


def text_field(payload: Column, path: str) -> Column:
    """Text at a dotted path of JSON; numbers, booleans, objects and arrays are no text."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), "$." + path, "variant"))
    return F.when(kind == "STRING", F.get_json_object(payload, "$." + path))


#: Fields that may name an image, the first that is text counts.
IMAGE_FIELDS = ("image_url", "img_url", "url", "thumbnail")


def image_field(payload: Column) -> Column:
    return F.coalesce(*[text_field(payload, f) for f in IMAGE_FIELDS])


def round_to(value: Column, places: int = 6) -> Column:
    """Half away from zero; null where the value is null or not finite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.round(value, places))


def type_parameters(type_name: Column) -> Column:
    """Parameters of a generic type: split at the commas outside any inner brackets, trimmed; none without brackets."""
    inner = F.regexp_extract(type_name, "<(.+)>", 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        mark = F.when((c == ",") & (acc["depth"] == 0), F.lit("\n")).otherwise(c)
        return F.struct(depth.alias("depth"), F.concat(acc["text"], mark).alias("text"))

    marked = F.aggregate(F.split(inner, ""), start, step, lambda acc: acc["text"])
    parts = F.transform(F.split(marked, "\n"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def package_id(type_name: Column) -> Column:
    found = F.regexp_extract(type_name, "^(0x[a-fA-F0-9]+)::", 1)
    return F.when(found != "", found)


def looks_like_name(ref: Column) -> Column:
    """Whether a reference is a registered name and no address."""
    r = F.trim(ref)
    return ~F.startswith(r, F.lit("0x")) & (F.startswith(r, F.lit("@")) | F.contains(r, F.lit("/")))


def valid_module_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))


def bound_kind(value: Column) -> Column:
    """What a bound is: checkpoint (digits), now, time (ISO), none (null or empty), or invalid, which callers turn
    into an error or into no bound."""
    v = F.trim(value)
    return (
        F.when(value.isNull() | (value == ""), "none").when(v.rlike("^[0-9]+$"), "checkpoint").when(F.lower(v) == "now", "now")
        .when(F.try_to_timestamp(v).isNotNull(), "time").otherwise("invalid")
    )
