"""Secret scan with a trigram index. DataFrame functions only."""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import materialize

#: Candidate rows that may be broadcast (16 bytes each); beyond it the join is by shuffle.
BROADCAST_ROWS = 500_000
#: Exact strings that one part of a pattern may stand for before the part counts as unknown.
EXPAND = 32
MASK_BITS = 60


@dataclass(frozen=True)
class Rule:
    """pattern: for Java's and Python's engines alike. group: the group whose length counts. least: that length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed by the contract. Runs are greedy, so a minimum length in the pattern of access and hex gives the same spans
#: as matching runs of any length and dropping short ones, without a match at every letter.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: A private key from BEGIN to the next END. Where another BEGIN, or nothing, comes first, the header fields and the
#: base64 lines after BEGIN (line breaks may be escaped or quoted) and a last line that may be short or cut off. The
#: loops are possessive, so each text is read once and Java's engine needs no stack for them.
_GAP = r"""(?:[ \t\r\n"',+>#*|]|\\[nrt])"""
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
    r"(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++"
    rf"(?:{_GAP}++[A-Za-z0-9+/]++(?:={{1,2}}|(?<=[0-9+/])|(?=[\r\n\\]|\Z)))?)?)"
)
#: Published formats of credentials that the base rules may miss.
MORE_RULES = (
    Rule("pem", PEM),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """Trigrams that any match must hold, in lower case: all of the clauses; of a clause, one alternative; of an
    alternative, every trigram. No clause: the pattern has no mandatory trigram and every text is scanned."""
    clauses: Query = []
    run: set[str] = {""}

    def flush() -> None:
        nonlocal run
        if run and all(len(s) >= 3 for s in run):
            clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}, key=sorted))
        run = {""}

    def exact(node) -> set[str] | None:
        """All strings that a part stands for, or None."""
        kind, arg = node
        if kind is rc.LITERAL:
            return {chr(arg).lower()}
        if kind is rc.IN and all(k is rc.LITERAL for k, _ in arg):
            return {chr(c).lower() for _, c in arg}
        if kind is rc.SUBPATTERN:
            return sequence(arg[3])
        if kind is rc.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if kind is rc.MAX_REPEAT and arg[1] is not rc.MAXREPEAT and arg[1] <= 4:
            own = sequence(arg[2])
            return None if own is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(own, repeat=n)}
        return None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            own = exact(node)
            if own is None or len(out) * len(own) > EXPAND:
                return None
            out = {a + b for a in out for b in own}
        return out

    def walk(nodes) -> None:
        nonlocal run
        for node in nodes:
            own = exact(node)
            if own is not None and len(run) * len(own) <= EXPAND:
                run = {a + b for a in run for b in own}
            elif node[0] is rc.SUBPATTERN:
                walk(node[1][3])
            elif own is not None:
                flush()
                run = own
            else:
                flush()
                if node[0] is rc.MAX_REPEAT and node[1][0] >= 1:
                    walk(node[1][2])
                    flush()
        return

    walk(rp.parse(pattern))
    flush()
    return clauses


def _masks(trigrams: list[str], wanted: frozenset[str]) -> list[int]:
    out = [0] * (len(trigrams) // MASK_BITS + 1)
    for t in wanted:
        i = trigrams.index(t)
        out[i // MASK_BITS] |= 1 << i % MASK_BITS
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): bit i of rules is set if the index admits rule i for the document. Rules without mandatory
    trigrams admit every document and are not listed here; documents that no rule admits have no row."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for alt in clause for t in alt})
    if not trigrams:
        return docs.select("doc_id", F.lit(0).cast("long").alias("rules")).limit(0)
    low = docs.where("doc_id is not null").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    postings = low.select("doc_id", F.explode(found).alias("trigram"))
    n = len(trigrams) // MASK_BITS + 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % MASK_BITS)
    held = postings.groupBy("doc_id").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / MASK_BITS) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(n)])

    def holds(alt: frozenset[str]) -> Column:
        out = F.lit(True)
        for k, m in enumerate(_masks(trigrams, alt)):
            if m:
                out = out & (F.col(f"m{k}").bitwiseAND(F.lit(m)) == F.lit(m))
        return out

    mask = F.lit(0).cast("long")
    for i, q in queries.items():
        admitted = F.lit(True)
        for clause in q:
            some = F.lit(False)
            for alt in clause:
                some = some | holds(alt)
            admitted = admitted & some
        mask = mask + F.when(admitted, F.lit(1 << i)).otherwise(F.lit(0))
    return held.select("doc_id", mask.cast("long").alias("rules")).where("rules <> 0")


def admitted(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """docs with a column `rules`: bit i is set if rule i has to be verified on the row."""
    every = sum(1 << i for i, r in enumerate(rules) if not trigram_query(r.pattern))
    picked = materialize(candidates(docs, rules), "candidates")
    side = F.broadcast(picked) if picked.count() <= BROADCAST_ROWS else picked
    mask = F.when(F.col("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce("rules", F.lit(0)).bitwiseOR(F.lit(every)))
    return docs.join(side, "doc_id", "left").withColumn("rules", mask.cast("long"))


def _hits(i: int, rule: Rule) -> Column:
    """Matches of a rule in `text`, in order: kind, number, code points since the match before, length, whether it counts."""
    text = F.col("text")
    # \G ties each attempt to the end of the match before: the gap is found once and never tried again from within
    tied = lambda p, g: F.regexp_extract_all(text, F.lit(r"\G((?s:.*?))(" + p + ")"), F.lit(g))
    hit = tied(rule.pattern, 2)
    rest = tied(rule.pattern, 2 + rule.group) if rule.group else hit
    rows = F.transform(
        F.arrays_zip(tied(rule.pattern, 1).alias("gap"), hit.alias("hit"), rest.alias("counts")),
        lambda x, n: F.struct(F.lit(i).alias("kind"), n.alias("n"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("len"), (F.length(x["counts"]) >= rule.least).alias("good")),
    )
    none = F.array().cast("array<struct<kind:int,n:int,gap:int,len:int,good:boolean>>")
    return F.when((F.col("rules").bitwiseAND(F.lit(1 << i)) != 0) & text.rlike(rule.pattern), rows).otherwise(none)


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per row of docs: doc_id, and spans, an array of (start, kind, end) in order; start and end count code
    points, kind is the number of the rule.

    A text without hits has an empty array, as have null and empty texts. Rows that repeat an id are scanned each
    for itself (the index admits a rule for both if it does for one). Rows without an id are scanned in full. Whole
    texts are scanned, however long; of hits of one rule that overlap the leftmost, longest run counts. An empty table
    gives an empty result; columns other than doc_id and text are not looked at.
    """
    rows = docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    checked = admitted(rows, rules).select("uid", "doc_id", F.explode_outer(F.concat(*[_hits(i, r) for i, r in enumerate(rules)])).alias("h")).select("uid", "doc_id", "h.*")
    so_far = W.partitionBy("uid", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    placed = checked.repartition("uid").withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(so_far))
    span = F.when(F.col("good"), F.struct((F.col("stop") - F.col("len")).alias("start"), "kind", F.col("stop").alias("end")))
    return placed.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans")).drop("uid")


def digest(found: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """doc_id, a count for each base rule, the digest of the base spans, and all spans as text."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    return found.select("doc_id", *counts, F.sha2(said(F.filter("spans", lambda s: s["kind"] < base)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span that secret_scan finds replaced by the mark, and no other place of the text.

    Spans that overlap become one mark. The other columns and the other texts stay as they are, null and empty ones
    too; rows that repeat an id and rows without one are treated each for itself. Whole texts count, however long. An
    empty table gives an empty result; columns may have any names.
    """
    taken = {"rules", "doc_id", "text"} & {c for c in docs.columns if c not in ("doc_id", "text")}
    plain = docs.withColumnsRenamed({c: f"{c} (own)" for c in taken})
    none = F.array().cast("array<struct<start:int,end:int>>")
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def spans(i: int, rule: Rule) -> Column:
        def add(acc: Column, x: Column) -> Column:
            stop = acc["stop"] + x["gap"] + x["len"]
            return F.struct(stop.alias("stop"), F.when(x["good"], F.concat(acc["out"], F.array(span(stop - x["len"], stop)))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(_hits(i, rule), F.struct(F.lit(0).alias("stop"), none.alias("out")), add, lambda acc: acc["out"])

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last["start"], F.greatest(last["end"], x["end"]))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > x["start"]), longer).otherwise(F.concat(acc, F.array(x)))

    def before(x: Column, i: Column) -> Column:
        at = F.coalesce(F.get("marks (own)", i - 1)["end"], F.lit(0))
        return F.substring(F.col("text"), at + 1, x["start"] - at)

    hits = F.array_sort(F.concat(*[spans(i, r) for i, r in enumerate(rules)]))
    marks = F.aggregate(hits, none, join)
    rest = F.substring(F.col("text"), F.element_at("marks (own)", -1)["end"] + 1, F.length("text"))
    marked = admitted(plain, rules).withColumn("marks (own)", marks)
    text = F.concat(F.array_join(F.transform("marks (own)", before), mark), F.lit(mark), rest)
    out = marked.withColumn("text", F.when(F.size("marks (own)") > 0, text).otherwise(F.col("text")))
    return out.drop("marks (own)", "rules").withColumnsRenamed({f"{c} (own)": c for c in taken}).select(*docs.columns)
