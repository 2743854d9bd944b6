"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .context_tree import lm_scores
from .exact_dedup import exact_dedup
from .hash_tree import even_tree, grown, shard
from .nearest import nearest
from .packing import PackParams, best_fit_pack
from .pieces import SampleParams, sampled
from .quality import quality_scores
from .ranked_search import ranked
from .secrets import BASE_RULES, MORE_RULES, digest, secret_scan
from .simhash import simhash_dedup
from .skip_chain import digest as entity_digest
from .skip_chain import find_entities
from .spelling import spelling_groups
from .wrappers import main_text


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_read(spark, sf_dir, "documents"))


def op2_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_digest(find_entities(_read(spark, sf_dir, "documents")))


def word_tokenizer() -> str:
    """The tokenizer file of the packing query; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_read(spark, sf_dir, "documents"), PackParams(word_tokenizer()))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secret_scan(_read(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "embeddings"))


def op8_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sampled(_read(spark, sf_dir, "documents"), SampleParams(public_tokenizers.path("piece_bpe_32k.model")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_read(spark, sf_dir, "documents"))


#: 24 shards in 2 regions of 3 racks, and the same with one more.
TREE = even_tree(2, 3, 4)
LARGER = grown(TREE, 24)


def op11_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_read(spark, sf_dir, "documents"), TREE, LARGER)


#: The 256 remainders of CRC-32 as a list, and the CRC-32 of a text's bytes from it, one byte after the other.
CRC_TABLE = """crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS rest FROM range(256) AS r(i))"""


def _crc32(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: xor(a >> 8, rest[(xor(a, b) & 255) + 1])), 4294967295)"


def _shard_sql() -> str:
    """The descent with a table of the tree's nodes: the child of the least draw at each level."""
    nodes = []
    for tree, racks in (("now", TREE), ("then", LARGER)):
        for g, of in racks.items():
            nodes.append((tree, 1, "", f"/{g}", sum(sum(s.values()) for s in of.values())))
            for r, shards in of.items():
                nodes.append((tree, 2, f"/{g}", f"/{g}/{r}", sum(shards.values())))
                nodes += [(tree, 3, f"/{g}/{r}", f"/{g}/{r}/{s}", w) for s, w in shards.items()]
    values = ", ".join(f"('{t}', {k}, '{up}', '{path}', {w}::DOUBLE)" for t, k, up, path, w in nodes)
    down = lambda k, before: f"""l{k} AS (SELECT uid, key, b.tree, arg_min(n.path, -ln((('0x' || substr(md5(key || n.path), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2, 52)) / w) AS path
            FROM {before} AS b JOIN nodes AS n ON n.tree = b.tree AND level = {k} AND up = b.path GROUP BY ALL)"""  # noqa: E731
    return f"""
        WITH {CRC_TABLE}, nodes(tree, level, up, path, w) AS (VALUES {values}),
        t AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS body FROM documents),
        l0 AS (SELECT uid, key, tree, '' AS path FROM t, (SELECT DISTINCT tree FROM nodes)),
        {down(1, "l0")}, {down(2, "l1")}, {down(3, "l2")},
        s AS (SELECT uid, max(split_part(path, '/', 4)::INT) FILTER (tree = 'now') AS shard, max(split_part(path, '/', 4)::INT) FILTER (tree = 'then') AS grown_shard FROM l3 GROUP BY uid),
        r AS (SELECT doc_id, strlen(body)::BIGINT + 8 AS size, {_crc32("body")} AS text_crc32, shard, grown_shard FROM t JOIN s USING (uid), crc)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM r"""


def op12_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SEARCH_SQL = f"""
    WITH t AS (SELECT uid, doc_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS uid, * FROM documents)),
    i AS (SELECT DISTINCT item, item_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
    g AS (SELECT count(DISTINCT uid) AS docs, count(*) AS terms FROM t),
    d AS (SELECT uid, doc_id, 100 - 90 + (90 * count(*) * any_value(docs)) // any_value(terms) AS m FROM t, g GROUP BY uid, doc_id),
    p AS (SELECT uid, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY uid, term),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term),
    s AS (SELECT item, item_id, uid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (uid) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_read(spark, sf_dir, "documents"))


#: Words that share a deletion, or of which one is the other's deletion, are near.
SPELLING_SQL = rf"""
    WITH RECURSIVE {CRC_TABLE},
    r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    d AS (SELECT id, run, count(*) AS k FROM r GROUP BY ALL),
    h AS (SELECT run, k, {_crc32("id || ':' || run")} AS h FROM d, crc WHERE length(run) >= 5),
    o AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
    v AS (SELECT word, sum(k)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
    e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v),
    near AS (
        SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM e AS a JOIN e AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.rest = v.word
        UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.rest = v.word),
    best AS (SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word),
    f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN other END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM v LEFT JOIN best USING (word)),
    way(word, place, steps) AS (SELECT word, word, 0 FROM f UNION ALL SELECT w.word, f.form, steps + 1 FROM way AS w JOIN f ON f.word = w.place WHERE f.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(place, steps) AS root FROM way GROUP BY word) USING (word)"""


#: What may stand between the lines of a key.
_BREAK = r"""(?:[ \t\r\n"',+>#*|]|\\[nrt])""".replace("'", "''")


def _key_sql(kind: int) -> str:
    """Private keys from the places of their BEGIN marks, for an engine without look-around: up to the END that is the
    next mark, else header fields, base64 lines and a last line that may be short."""
    return rf"""
        b AS (SELECT uid, unnest(regexp_extract_all(body, '(?s)(.*?)(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1)) AS gap, unnest(regexp_extract_all(body, '(?s)(.*?)(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 2)) AS hit,
            unnest(range(len(regexp_extract_all(body, '(?s)(.*?)(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1)))) AS n FROM t),
        b1 AS (SELECT uid, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY uid ORDER BY n) AS here FROM b),
        b2 AS (SELECT uid, here - length(hit) AS start, here, substr(body, here::BIGINT + 1) AS rest FROM b1 JOIN t USING (uid)),
        b3 AS (SELECT *, length(regexp_extract(rest, '(?s)^(.*?)-----(?:BEGIN|END) ', 1)) AS until, regexp_matches(rest, '-----(?:BEGIN|END) ') AS marked,
            length(regexp_extract(rest, '^(?:{_BREAK}*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*')) AS head FROM b2),
        b4 AS (SELECT *, CASE WHEN marked THEN length(regexp_extract(substr(rest, until + 1), '^-----END [A-Z ]*PRIVATE KEY-----')) ELSE 0 END AS ended,
            length(regexp_extract(substr(rest, head + 1), '^(?:{_BREAK}*[A-Za-z0-9+/]{{16,}}={{0,2}})*')) AS lines FROM b3),
        b5 AS (SELECT *, substr(rest, head + lines + 1) AS tail FROM b4),
        b6 AS (SELECT *, CASE WHEN lines > 0 THEN regexp_extract(tail, '^{_BREAK}+[A-Za-z0-9+/]+') ELSE '' END AS last FROM b5),
        b7 AS (SELECT *, substr(tail, length(last) + 1) AS after FROM b6),
        keys AS (SELECT uid, {kind} AS kind, start, 'pem:' || start::BIGINT || ':' || (here + CASE WHEN ended > 0 THEN until + ended ELSE head + lines + CASE
            WHEN last = '' THEN 0 WHEN after LIKE '=%' THEN length(last) + length(regexp_extract(after, '^={{1,2}}')) WHEN regexp_matches(last, '[0-9+/]$') OR after = '' OR regexp_matches(after, '^[\r\n\\]') THEN length(last) ELSE 0 END END)::BIGINT AS span FROM b7)"""


def _secret_sql() -> str:
    """Every rule's matches with the text before each, as positions from running sums."""
    rules = BASE_RULES + MORE_RULES
    tied = lambda r, g: f"unnest(regexp_extract_all(body, '(?s)(.*?)({r.pattern.replace(chr(39), chr(39) * 2)})', {g}))"
    hits = " UNION ALL ".join(
        f"SELECT uid, {i} AS kind, '{r.kind}' AS name, {r.least} AS least, {tied(r, 1)} AS gap, {tied(r, 2)} AS hit, {tied(r, 2 + r.group)} AS counts, "
        f"unnest(range(len(regexp_extract_all(body, '(?s)(.*?)({r.pattern.replace(chr(39), chr(39) * 2)})', 1)))) AS n FROM t"
        for i, r in enumerate(rules)
        if r.kind != "pem"
    )
    return f"""
        WITH t AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS body FROM documents),
        h AS ({hits}),
        p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY uid, kind ORDER BY n) AS stop FROM h),
        {_key_sql(next(i for i, r in enumerate(rules) if r.kind == "pem"))},
        s AS (SELECT uid, kind, stop - length(hit) AS start, name || ':' || (stop - length(hit))::BIGINT || ':' || stop::BIGINT AS span FROM p WHERE length(counts) >= least UNION ALL SELECT * FROM keys)
        SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
            sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE_RULES)}), '')) AS base_sha256,
            coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
        FROM t LEFT JOIN s USING (uid) GROUP BY uid, doc_id"""


QUERIES = {
    "op1_context_tree_weighting": op1_context_tree_weighting,
    "op2_wrapper_main_text": op2_wrapper_main_text,
    "op3_skip_chain_pii": op3_skip_chain_pii,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_kmeans_tree_neighbours": op7_kmeans_tree_neighbours,
    "op8_gumbel_segmentations": op8_gumbel_segmentations,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_hash_tree_shards": op11_hash_tree_shards,
    "op12_pair_bound_search": op12_pair_bound_search,
    "op13_spelling_groups": op13_spelling_groups,
}

ORACLE_SQL = {
    "op5_secret_scan": _secret_sql(),
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
    "op11_hash_tree_shards": _shard_sql(),
    "op12_pair_bound_search": SEARCH_SQL,
    "op13_spelling_groups": SPELLING_SQL,
}
