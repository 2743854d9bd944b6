"""Text of nested types of any depth.

A body is JSON: kind (parameter, vector, datatype, or a plain type's own word), name, index and args, a list of bodies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The plain types; visibilities and abilities by their words.
PLAIN = ("bool", "u8", "u16", "u32", "u64", "u128", "u256", "address")
VISIBILITY = {"PUBLIC": "public", "PRIVATE": "private", "FRIEND": "public(friend)"}
ABILITY = {"COPY": "copy", "DROP": "drop", "STORE": "store", "KEY": "key"}

#: A body that is open: the member that is read now, its own members, the open lists, and its finished arguments.
FRAME = {"key": "string", "kind": "string", "name": "string", "index": "int", "list": "int", "args": "array<string>"}
STACK = "array<struct<" + ",".join(f"`{n}`:{t}" for n, t in FRAME.items()) + ">>"
TOKEN = r'"(?:[^"\\]|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]+'


def unquoted(token: Column) -> Column:
    """The value of a token: text without its quotes, other words as they are, null for null."""
    escaped = F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")
    return F.when(F.contains(token, F.lit("\\")), escaped).when(token.startswith('"'), F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(F.nullif(token, F.lit("null")))


def _frame(of: Column | None = None, **changed: Column) -> Column:
    start = {"list": F.lit(0), "args": F.array()}
    return F.struct(*[(changed[n] if n in changed else start.get(n, F.lit(None)) if of is None else of[n]).cast(t).alias(n) for n, t in FRAME.items()])


def _written(f: Column, plain: bool) -> Column:
    """The text of a body whose arguments are finished."""
    args, word = f["args"], f["kind"]
    return (
        F.when(word == "parameter", F.concat(F.lit("T"), F.coalesce(f["index"], F.lit(0)).cast("string")))
        .when(word == "vector", F.concat(F.lit("vector<"), F.coalesce(F.get(args, F.lit(0)), F.lit("?")), F.lit(">")))
        .when(word == "datatype", F.concat(F.coalesce(f["name"], F.lit("?")), F.when(F.size(args) > 0, F.concat(F.lit("<"), F.array_join(args, ", "), F.lit(">"))).otherwise("")))
        .when(word.isin(*PLAIN) if plain else word.isNotNull(), word)
        .otherwise("unknown")
    )


def _step(acc: Column, token: Column, plain: bool) -> Column:
    """The state after one more token. A body that ends is written, and its text becomes its owner's next argument."""
    stack = acc["stack"]
    top, owner = F.try_element_at(stack, F.lit(-1)), F.try_element_at(stack, F.lit(-2))
    less = lambda n: F.slice(stack, 1, F.greatest(F.size(stack) - n, F.lit(0)))
    now = lambda stack=stack, said=acc["said"], out=acc["out"]: F.struct(stack.cast(STACK).alias("stack"), said.cast("string").alias("said"), out.cast("string").alias("out"))
    put = lambda **changed: now(F.concat(less(1), F.array(_frame(top, **changed))))
    value = unquoted(token)
    member = lambda name: F.when((top["key"] == name) & (top["list"] == 0), value).otherwise(top[name])
    took = F.concat(owner["args"], F.when((owner["key"] == "args") & (owner["list"] == 1), F.array(_written(top, plain))).otherwise(F.array()))
    ended = F.when(F.size(stack) > 1, now(F.concat(less(2), F.array(_frame(owner, args=took))))).otherwise(now(F.array(), out=_written(top, plain)))
    return (
        F.when(token == "{", now(F.concat(stack, F.array(_frame())))).when(token == "}", ended)
        .when(token == "[", put(list=top["list"] + 1)).when(token == "]", put(list=top["list"] - 1))
        .when(token == ":", put(key=acc["said"])).when(token == ",", F.when(top["list"] == 0, put(key=F.lit(None))).otherwise(now()))
        .when(top["key"].isNull(), now(said=value)).otherwise(put(kind=member("kind"), name=member("name"), index=member("index").try_cast("int")))
    )


def type_text(body: Column, plain: bool = True) -> Column:
    """The type as text, whatever its depth: the tokens of the JSON are folded over a stack of open bodies.

    `T<index>` of a parameter, `vector<...>` (`?` without an inner type), a datatype's name (`?` without one) with its
    arguments in angle brackets. Other words are themselves if plain types, else `unknown`, or always themselves where
    plain is false. A missing or unreadable body is unknown.
    """
    start = F.struct(F.array().cast(STACK).alias("stack"), F.lit(None).cast("string").alias("said"), F.lit(None).cast("string").alias("out"))
    read = F.aggregate(F.regexp_extract_all(body, F.lit(TOKEN), 0), start, lambda acc, token: _step(acc, token, plain), lambda acc: acc["out"])
    return F.coalesce(F.when(F.get_json_object(body, "$.kind").isNotNull(), read), F.lit("unknown"))


def signature_text(reference: Column, body: Column) -> Column:
    """A parameter's text: `&mut ` or `&` before the type of a reference."""
    mark = F.when(reference == "mutable", "&mut ").when(reference == "immutable", "&").otherwise("")
    return F.concat(mark, type_text(body, plain=False))


def ordered_fields(fields: Column) -> Column:
    """`name: type` of fields (an array of name, position, type) by position; a missing position is 0, equal ones stay in order."""
    placed = F.transform(fields, lambda f, i: F.struct(F.coalesce(f["position"], F.lit(0)).alias("position"), i.alias("at"), f["name"].alias("name"), f["type"].alias("type")))
    return F.transform(F.array_sort(placed), lambda f: F.concat(F.coalesce(f["name"], F.lit("")), F.lit(": "), type_text(f["type"])))


def word_of(value: Column, words: dict[str, str]) -> Column:
    """A visibility's or ability's word, `unknown` for any other."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), value), F.lit("unknown"))
