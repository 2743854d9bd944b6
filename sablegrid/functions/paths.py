"""Paths of the members of JSON objects, by a fold over tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import NUMBER
from .types import TOKEN, unquoted

#: An object that is open: its path (null within a list), the member that is read now, and its open lists.
FRAME = {"path": "string", "key": "string", "list": "int"}
STACK = "array<struct<" + ",".join(f"`{n}`:{t}" for n, t in FRAME.items()) + ">>"


def _frame(path: Column, key: Column, lists: Column) -> Column:
    return F.struct(*[c.cast(t).alias(n) for c, (n, t) in zip((path, key, lists), FRAME.items(), strict=True)])


def _step(acc: Column, token: Column) -> Column:
    stack, said, out = acc["stack"], acc["said"], acc["out"]
    top = F.try_element_at(stack, F.lit(-1))
    less = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
    now = lambda stack=stack, said=said, out=out: F.struct(stack.cast(STACK).alias("stack"), said.cast("string").alias("said"), out.cast("array<string>").alias("out"))
    put = lambda key=top["key"], lists=top["list"]: now(F.concat(less, F.array(_frame(top["path"], key, lists))))
    own = F.when(F.size(stack) == 0, "").when(top["list"] == 0, F.when(top["path"] == "", top["key"]).otherwise(F.concat(top["path"], F.lit("."), top["key"])))
    value = unquoted(token)
    number = F.coalesce(value.rlike(NUMBER) & (F.abs(F.trim(value).try_cast("double")) < float("inf")), F.lit(False))
    return (
        F.when(token == "{", now(F.concat(stack, F.array(_frame(own, F.lit(None), F.lit(0)))))).when(token == "}", now(less))
        .when(token == "[", put(lists=top["list"] + 1)).when(token == "]", put(lists=top["list"] - 1))
        .when(token == ":", put(key=said)).when(token == ",", F.when(top["list"] == 0, put(key=F.lit(None))).otherwise(now()))
        .when(top["key"].isNull(), now(said=value)).when(number & own.isNotNull(), now(out=F.concat(out, F.array(own)))).otherwise(now())
    )


def numeric_paths(payload: Column) -> Column:
    """Dotted paths of the members of a JSON object, at any depth, that are finite numbers or text that reads as one.

    Lists are passed over with all they hold. Sorted, each once; none for null, for text that is no JSON and for other
    values than objects.
    """
    start = F.struct(F.array().cast(STACK).alias("stack"), F.lit(None).cast("string").alias("said"), F.array().cast("array<string>").alias("out"))
    read = F.aggregate(F.regexp_extract_all(payload, F.lit(TOKEN), 0), start, _step, lambda acc: acc["out"])
    return F.when(F.json_object_keys(payload).isNotNull(), F.array_sort(F.array_distinct(read))).otherwise(F.array().cast("array<string>"))
