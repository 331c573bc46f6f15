"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.embeddings import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.pii import find, train

    docs = _read(spark, sf_dir, "documents")
    return find(docs, train(docs))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.secrets import scan

    return scan(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.toxicity import score, train

    docs = _read(spark, sf_dir, "documents")
    return score(docs, train(docs, _read(spark, sf_dir, "labels")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.urls import judge

    return judge(_read(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.langid import identify, train

    docs = _read(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.exact import exact_duplicates

    return exact_duplicates(_read(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathloom.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_CALLS = (op1_minhash_near_dedup, op2_embedding_near_dedup, op3_pii, op4_secrets, op5_toxicity, op6_url_filter, op7_best_fit_packing, op8_language, op9_exact_dedup, op10_source_mix)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _CALLS}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The smallest node reachable over links (a, b), both ways, for each node of a table nodes.
_REACH = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, b FROM reach JOIN both_ways ON a = r)
        , comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
        , s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS sh FROM w)
        , n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
        , shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL)
        , links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 75 * (p.n + q.n - i))
        , nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON id = doc_id""",
    "op2_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
        , ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)
        , links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93)
        , nodes AS (SELECT vec_id AS id FROM v), {_REACH}, deg AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp ON comp.id = vec_id LEFT JOIN deg ON deg.id = vec_id""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
}


# ---- what SQL can state of the operators that it cannot express as a whole: the same results, without the learned columns


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii(spark, sf_dir).drop("spans")


def secrets_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secrets(spark, sf_dir).drop("spans")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page, and the verdict where a rule gives it."""
    return op6_url_filter(spark, sf_dir).selectExpr("page_id", "host", "path", "rule", "if(rule is null, null, verdict) AS verdict")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of every document, and whether the words taken keep to twice its size."""
    return op10_source_mix(spark, sf_dir).selectExpr("doc_id", "size", "source_size", "round(target, 3) AS target", "taken <= 2 * size AS within")


def tokens_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's pieces: that they are numbered, follow one another and, but for the last, are whole; and that sequences hold."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    rows = op7_best_fit_packing(spark, sf_dir)
    own = W.partitionBy("doc_id").orderBy("piece")
    in_order = (F.col("piece") == F.row_number().over(own) - 1) & (F.col("start") == 4096 * F.col("piece")) & ((F.lead("piece").over(own).isNull()) | (F.col("length") == 4096))
    place = W.partitionBy("sequence_id").orderBy("offset")
    gapless = (F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("length")).over(place), F.lit(0))) & (F.col("offset") + F.col("length") <= 4096)
    return rows.select("doc_id", in_order.alias("a"), gapless.alias("b")).groupBy("doc_id").agg(F.bool_and("a").alias("in_order"), F.bool_and("b").alias("gapless"))


def held_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the two classifiers hold out, and that their scores and predictions are of the promised form."""
    from pyspark.sql import functions as F

    toxic = op5_toxicity(spark, sf_dir).select("doc_id", "held_out", (F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= 0.7).cast("int"))).alias("toxic_ok"))
    lang = op8_language(spark, sf_dir).select("doc_id", F.col("held_out").alias("h8"), F.col("score").between(0, 1).alias("lang_ok"))
    return toxic.join(lang, "doc_id").select("doc_id", "toxic_ok", "lang_ok", (F.col("held_out") == F.col("h8")).alias("same_rows"))


CHECKED: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (pii_base_spans, secrets_base_spans, url_rules, mix_targets, tokens_cut, held_out_rows)}


def _spans(kinds: list[tuple[str, str, str]], order: str) -> str:
    """Spans of each kind (name, pattern, condition on the match v), with places from what stands between matches, and their digest."""
    each = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {n} AS k, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS s FROM d" for n, (k, p, _) in enumerate(kinds))
    good = " OR ".join(f"(kind = '{k}' AND {c})" for k, _, c in kinds)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in kinds)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({each})
        , x AS (SELECT doc_id, kind, k, m[i] AS v, list_sum(list_transform(s[1 : i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda z: length(z))), 0) AS b FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM f))
        , o AS (SELECT doc_id, {counts}, string_agg(kind || ':' || b || ':' || (b + length(v)), ',' ORDER BY {order}) AS l FROM (SELECT doc_id, kind, k, v, CAST(b AS BIGINT) AS b FROM x WHERE {good}) GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in kinds)}, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN o USING (doc_id)"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(({_DIGITS})[-i] AS INTEGER) ELSE CAST(({_DIGITS})[-i] AS INTEGER) * 2 - CASE WHEN CAST(({_DIGITS})[-i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_ASSIGNMENT = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
CHECKED_SQL: dict[str, str] = {
    "pii_base_spans": _spans(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0"),
            ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
        ],
        "k, b",
    ),
    "secrets_base_spans": _spans([("assign", _ASSIGNMENT, f"length(regexp_extract(v, '{_ASSIGNMENT}', 2)) >= 12"), ("access", "AKIA[A-Z0-9]+", "length(v) >= 18"), ("hex", "[0-9a-f]+", "length(v) >= 16")], "b, k"),
    "url_rules": """
        WITH r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
        , a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
        , b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a)
        , c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
        , f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, verdict FROM c LEFT JOIN f USING (page_id)""",
    "mix_targets": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)
        , s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source), w AS (SELECT source, n, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM s)
        , o AS (SELECT *, 2e0 * n / w AS ratio, row_number() OVER (ORDER BY 2e0 * n / w, source NULLS LAST) AS k FROM w)
        , u AS (SELECT *, (1.5e0 * sum(n) OVER () - coalesce(sum(2 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM o)
        , cut AS (SELECT k AS first, unit FROM u WHERE unit <= ratio ORDER BY k LIMIT 1)
        , t AS (SELECT source, n, CASE WHEN first IS NULL OR k < first THEN 2e0 * n ELSE cut.unit * w END AS target FROM u LEFT JOIN cut ON true)
        SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, round(target, 3) AS target, true AS within FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "tokens_cut": "SELECT DISTINCT doc_id, true AS in_order, true AS gapless FROM documents",
    "held_out_rows": "SELECT doc_id, true AS toxic_ok, true AS lang_ok, true AS same_rows FROM documents",
}
