"""Table-driven rules over commands, packages and capabilities, and version diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import coin_symbol

#: Words for actions; others are shown as they are.
ACTION_WORDS = {
    "swap": "Swap", "add_liquidity": "Add liquidity", "remove_liquidity": "Remove liquidity", "open_position": "Open position", "close_position": "Close position",
    "deposit": "Deposit", "withdraw": "Withdraw", "borrow": "Borrow", "repay": "Repay", "flash_loan": "Flash loan", "flash_repay": "Repay flash loan",
    "stake": "Stake", "unstake": "Unstake", "transfer": "Transfer", "claim_rewards": "Claim rewards", "liquidate": "Liquidate", "create_obligation": "Create obligation",
    "register": "Register", "renew": "Renew", "register_blob": "Register blob", "certify_blob": "Certify blob", "place_order": "Place order", "cancel_order": "Cancel order",
}


def match_operations(commands: DataFrame, patterns: DataFrame) -> DataFrame:
    """Each command with action and skip of the first pattern (least priority) of its module whose prefix fits.

    The patterns are an index by module and prefix: a call asks it for the beginnings of its function in each length
    that a pattern has, by one equi-join, and only distinct calls ask. Commands are joined to the answers once; none
    is grouped.
    """
    lengths = [r[0] for r in patterns.select(F.length("prefix")).distinct().collect()]  # one for each length of a prefix
    starts = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("function"))
    asked = commands.select("module", "function").distinct().select("*", F.explode(F.transform(starts, lambda n: F.substring(F.col("function"), F.lit(1), n))).alias("prefix"))
    found = asked.join(patterns, ["module", "prefix"]).groupBy("module", "function").agg(F.min(F.struct("priority", "action", "skip")).alias("b"))
    return commands.join(found, ["module", "function"], "left").select(*commands.columns, F.col("b.action").alias("action"), F.col("b.skip").alias("skip"))


#: What other commands than calls say; the rest of them is infrastructure.
COMMAND_WORDS = {"transfer": "Transfer to recipient", "publish": "Publish new package", "upgrade": "Upgrade package"}
#: Actions that name the coin of their first type argument, and with which word the protocol follows.
COIN_ACTIONS = {"flash_loan": "via", "flash_repay": "via", "deposit": "on", "withdraw": "on", "borrow": "on", "repay": "on"}


def short_package(package: Column) -> Column:
    """Long addresses by their ends."""
    return F.when(F.length(package) > 16, F.concat(F.substring(package, 1, 10), F.lit("…"), F.right(package, F.lit(4)))).otherwise(package)


def action_text(action: Column, protocol: Column, type_args: Column) -> Column:
    """An operation in words, with the coins of its type arguments where the action has them."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ACTION_WORDS.items() for x in pair]), action), action)
    coin = lambda n: coin_symbol(F.get(type_args, F.lit(n)))
    then = lambda word: F.when(protocol.isNotNull(), F.concat(F.lit(f" {word} "), protocol)).otherwise("")
    out = F.when((action == "swap") & (F.size(type_args) >= 2), F.concat(label, F.lit(" "), coin(0), F.lit(" → "), coin(1), then("on")))
    for word in ("via", "on"):
        named = action.isin(*[a for a, w in COIN_ACTIONS.items() if w == word]) & (F.size(type_args) >= 1)
        out = out.when(named, F.concat(label, F.lit(" "), coin(0), then(word)))
    return out.otherwise(F.concat(label, then("on")))


def decode(operations: DataFrame, protocols: DataFrame, *more: Column) -> DataFrame:
    """digest, protocols (sorted), actions (in order): what each transaction does, in words. Skipped operations are left
    out. operations may have type_args (an array of types) and kind (call, transfer, publish, upgrade or another).
    more: what else is told of a transaction's operations, in the same pass."""
    have = operations.columns
    met = operations.join(protocols, "package", "left")
    args = F.coalesce("type_args", F.array().cast("array<string>")) if "type_args" in have else F.array().cast("array<string>")
    call = F.concat_ws("::", "module", "function")
    text = (
        F.when(F.col("skip"), F.lit(None)).when(F.col("action").isNotNull(), action_text(F.col("action"), F.col("protocol"), args))
        .when(F.col("protocol").isNotNull(), F.concat(F.lit("Call "), call, F.lit(" on "), F.col("protocol"))).otherwise(F.concat(F.lit("Call "), short_package(F.col("package")), F.lit("::"), call))
    )
    protocol = F.col("protocol")
    if "kind" in have:
        called = F.col("kind") == "call"
        text = F.when(called, text).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for pair in COMMAND_WORDS.items() for x in pair]), F.col("kind")))
        protocol = F.when(called, protocol)
    said = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("ord", text.alias("text")))))  # the commands of one transaction
    return met.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set(protocol)), ",").alias("protocols"), F.array_join(F.transform(said, lambda x: x["text"]), "; ").alias("actions"), *more)


def token_flow(tx: DataFrame, changes: DataFrame) -> DataFrame:
    """digest, ord, coin (its symbol), amount, raw_type: what each transaction's sender gains and loses, in order."""
    own = changes.join(tx.select("digest", F.col("sender").alias("address")), ["digest", "address"], "left_semi")
    return own.select("digest", "ord", coin_symbol(F.col("coin")).alias("coin"), F.col("cents").alias("amount"), F.col("coin").alias("raw_type"))


def decoded(tx: DataFrame, operations: DataFrame, protocols: DataFrame) -> DataFrame:
    """digest, protocols, actions, token_flow (amount and coin of each change of the sender, in order) of every transaction.

    operations have changes, an array of ord, sender, address, coin and cents, so all that is told of a transaction comes
    from one pass over its operations, which move once."""
    own = F.transform(F.filter("changes", lambda x: x["address"] == x["sender"]), lambda x: F.struct(x["ord"], F.concat_ws(" ", x["cents"].cast("string"), coin_symbol(x["coin"])).alias("text")))
    flow = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list(own))), lambda x: x["text"]), "; ").alias("token_flow")  # of one transaction
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return tx.select("digest").join(decode(operations, protocols, flow), "digest", "left").select("digest", empty("protocols"), empty("actions"), empty("token_flow"))


#: Rules over a transaction's calls, code and severity; packages of the system; words of functions; how
#: many packages are a composition.
ANOMALIES = {"publishes-or-upgrades": "high", "unverified-package-call": "medium", "flashloan-pattern": "info", "multi-package-composition": "info"}
SYSTEM, FLASH, BORROW, REPAY, COMPOSITION = ("1", "2", "3"), "flash", "borrow", "repay", 4
#: Rules over a package's surface, code and severity, and the patterns of names and parameters they go by.
FINDINGS = {
    "freeze-authority": "high", "mint-authority": "medium", "privileged-capability": "medium", "handles-funds": "info", "uses-randomness": "info", "hot-potato": "info", "no-public-api": "info",
}
DENY_NAME, DENY_PARAMS, DENY_STRUCT = "(?i)deny", "deny_list::DenyList|coin::DenyCap", "(?i)DenyCap"
TREASURY_PARAMS, MINT_NAME = "coin::TreasuryCap", "(?i)(^|_)mint($|_)"
FUNDS_PARAMS, RANDOM_PARAMS = r"coin::Coin|balance::Balance|::sui::SUI\b", "random::Random"
STANDARD_CAPS, CAP_NAME, ADMIN_NAME = "^(TreasuryCap|DenyCap|DenyCapV2|UpgradeCap|CoinMetadata)$", "Cap$", "(?i)(Admin|Owner)"


def found_rows(tests: dict[str, Column], severities: dict[str, str]) -> Column:
    """code, severity, evidence_count of the rules whose count is above 0, as an array."""
    rows = [F.when(n > 0, F.struct(F.lit(code).alias("code"), F.lit(severities[code]).alias("severity"), n.cast("long").alias("evidence_count"))) for code, n in tests.items()]
    return F.array_compact(F.array(*rows))


def anomalies(commands: DataFrame, protocols: DataFrame) -> DataFrame:
    """digest, code, severity, evidence_count: a row for each rule that a transaction's calls meet.

    system packages are the short forms 1, 2 and 3 without leading zeros. commands may have a kind column (call,
    publish, upgrade); without one all are calls.
    """
    c = commands if "kind" in commands.columns else commands.withColumn("kind", F.lit("call"))
    met = c.join(protocols.select("package", F.lit(True).alias("known")), "package", "left")
    call = F.col("kind") == "call"
    system = F.regexp_replace(F.col("package"), "^0x0*", "").isin(*SYSTEM)
    fn = F.lower("function")
    has = lambda word: call & fn.rlike(f"(^|_){word}($|_)")
    # a transaction's packages first: distinct counts beside others would copy each row for each of them
    each = met.groupBy("digest", "package").agg(
        F.count_if(F.col("kind").isin("publish", "upgrade")).alias("published"), F.max(F.when(call, F.col("known").isNull() & ~system)).alias("unverified"),
        F.count_if(call & F.contains(fn, F.lit(FLASH))).alias("flash"), F.count_if(has(BORROW)).alias("borrowed"), F.count_if(has(REPAY)).alias("repaid"), F.max(F.when(call, F.col("package").isNotNull())).alias("called"),
    )
    seen = each.groupBy("digest").agg(*[F.sum(n).alias(n) for n in ("published", "flash", "borrowed", "repaid")], F.count_if("unverified").alias("unverified"), F.count_if("called").alias("packages"))
    both = (F.col("borrowed") > 0) & (F.col("repaid") > 0)
    flash = F.when(F.col("flash") > 0, F.col("flash")).when(both, F.col("borrowed") + F.col("repaid")).otherwise(0)
    many = F.when(F.col("packages") >= COMPOSITION, F.col("packages")).otherwise(0)
    tests = dict(zip(ANOMALIES, (F.col("published"), F.col("unverified"), flash, many), strict=True))
    return seen.select("digest", F.explode(found_rows(tests, ANOMALIES)).alias("r")).select("digest", "r.*")


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(F.lit("high"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("info"), F.lit(2), F.lit("low"), F.lit(3)), severity)


def package_findings(functions: DataFrame, structs: DataFrame) -> DataFrame:
    """package, code, severity, evidence_count: rules over the surface of a package.

    functions: package, name, is_public, params (text). structs: package, name, abilities (a number).
    """
    name, params, public = F.col("name"), F.col("params"), F.col("is_public")
    f = functions.groupBy("package").agg(
        F.count(F.lit(1)).alias("functions"), F.count_if(public).alias("public"), F.count_if(name.rlike(DENY_NAME) | params.rlike(DENY_PARAMS)).alias("deny_f"),
        F.count_if(params.rlike(TREASURY_PARAMS)).alias("treasury"), F.count_if(public & name.rlike(MINT_NAME)).alias("mint"),
        F.count_if(public & params.rlike(FUNDS_PARAMS)).alias("funds"), F.count_if(params.rlike(RANDOM_PARAMS)).alias("random"),
    )
    standard = name.rlike(STANDARD_CAPS)
    s = structs.groupBy("package").agg(F.count_if(name.rlike(DENY_STRUCT)).alias("deny_s"), F.count_if(~standard & (name.rlike(CAP_NAME) | name.rlike(ADMIN_NAME))).alias("caps"), F.count_if(F.col("abilities") == 0).alias("potatoes"))
    both = f.join(s, "package", "full").na.fill(0)
    c = F.col
    closed = F.when((c("functions") > 0) & (c("public") == 0), c("functions")).otherwise(0)
    tests = dict(zip(FINDINGS, (c("deny_s") + c("deny_f"), c("treasury") + c("mint"), c("caps"), c("funds"), c("random"), c("potatoes"), closed), strict=True))
    return both.select("package", F.explode(found_rows(tests, FINDINGS)).alias("r")).select("package", "r.*")


def capability_kind(type_name: Column) -> Column:
    """upgrade, treasury, deny, admin (any other type that ends in Cap) or null; generics are not looked at."""
    base = F.element_at(F.split(type_name, "<", 2), 1)
    last = F.element_at(F.split(base, "::"), -1)
    two = "0x" + "2".zfill(64)
    return (
        F.when(base == f"{two}::package::UpgradeCap", "upgrade").when(base == f"{two}::coin::TreasuryCap", "treasury")
        .when(base.isin(f"{two}::coin::DenyCap", f"{two}::coin::DenyCapV2"), "deny").when(F.endswith(last, F.lit("Cap")), "admin")
    )


def capability_risk(kind: Column, owner: Column, policy: Column) -> Column:
    """info, low, medium or high by kind of capability, kind of owner and upgrade policy."""
    held, shared = owner == "address", owner == "shared"
    return (
        F.when(owner == "burned", "info").when((kind == "upgrade") & (policy == 255), "low")
        .when(kind.isin("upgrade", "treasury"), F.when(held, "high").otherwise("medium")).when(kind == "deny", F.when(held, "medium").otherwise("low"))
        .otherwise(F.when(held, "low").otherwise("info"))
    )


def capability_audit(created: DataFrame, current: DataFrame) -> DataFrame:
    """Capabilities created at publication (object_id, type, policy) with their owner now; one without an object is burned."""
    met = created.join(current.select("object_id", "owner_kind"), "object_id", "left")
    owner = F.coalesce("owner_kind", F.lit("burned"))
    kind = capability_kind(F.col("type"))
    return met.select("object_id", kind.alias("kind"), owner.alias("owner"), capability_risk(kind, owner, F.col("policy")).alias("risk")).where("kind is not null")


def line_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, added, removed: difference of two bags of lines (column line), after trailing space and CR are cut."""
    def bag(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.regexp_replace("line", r"\s+$", "").alias("line")).groupBy(*keys, "line").agg(F.count(F.lit(1)).alias(name))

    both = bag(before, "a").join(bag(after, "b"), [*keys, "line"], "full").na.fill(0, ["a", "b"])
    return both.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a"))).alias("added"), F.sum(F.greatest(F.lit(0), F.col("a") - F.col("b"))).alias("removed"))


def module_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, module, status (added, removed, changed, unchanged) of modules with their text."""
    clean = lambda df, name: df.select(*keys, "module", F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), r"(?m)[ \t\r]+$", "").alias(name))
    both = clean(before, "a").join(clean(after, "b"), [*keys, "module"], "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return both.select(*keys, "module", status.alias("status"))


#: Order of severities.
SEVERITIES = ("high", "medium", "info")


def by_severity(found: DataFrame, key: str) -> DataFrame:
    """Findings of each key with their position: by severity, then code."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return found.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(rank, "code")).cast("long"))


def api_totals(functions: DataFrame) -> DataFrame:
    """Functions (package, entry, vis) of each package by class; entry functions count as such alone."""
    of = lambda v: F.count_if(~F.col("entry") & (F.col("vis") == v)).alias(f"{v}_functions")
    return functions.groupBy("package").agg(F.count_if("entry").alias("entry_functions"), of("public"), of("friend"), of("private"))


def diff_summary(status: DataFrame, keys: list[str]) -> DataFrame:
    """Modules of each status, and whether two versions are identical."""
    kinds = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")]
    return status.groupBy(*keys).agg(*kinds, (F.count_if(F.col("status") != "unchanged") == 0).alias("identical"))


def churn(delta: DataFrame, key: str, limit: int) -> DataFrame:
    """Most changed first."""
    best = delta.orderBy(F.desc(F.col("added") + F.col("removed")), key).limit(limit)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.col("added") + F.col("removed")), key)).cast("long"))  # over the first rows alone
