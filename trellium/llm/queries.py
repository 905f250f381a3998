"""Queries of this subpackage by name, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_score, exact_dedup, mixing, ngram_join, repeats, resampling, token_codec, topk, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.encode_checked(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.mark(pages, url_filter.default_entries(pages))


def op3_compression_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return compression_score.score(docs, _read(spark, sf_dir, "labels")).drop("text")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chosen(_read(spark, sf_dir, "documents"))


def op5_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.shared_passages(_read(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 is a query, against all rows."""
    return topk.search(_read(spark, sf_dir, "embeddings"), asked=F.col("id") % 50 == 0).withColumn("score", F.round("score", 6))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.kept(_read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _read(spark, sf_dir, "labels")).select("doc_id", "log_weight", "key")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"))


def mix_sql(plan: mixing.Plan = mixing.Plan(), docs: str = "documents") -> str:
    """The mix in SQL: waterfilling by windows at each level, then the prefix of one seeded order a leaf."""
    case = lambda col, t: f"CASE {' '.join(f"WHEN {col} = '{k}' THEN {v}" for k, v in t.items())} ELSE {plan.other} END"

    def share(nodes: str, parents: str, name: str) -> str:
        by = f"PARTITION BY {parents}" if parents else ""
        return f"""(SELECT * EXCLUDE (cap, w, c0, w0, fits, cf, wo, budget), CASE WHEN fits THEN cap ELSE CAST((CAST(budget AS HUGEINT) - coalesce(cf, 0)) * w // nullif(wo, 0) AS BIGINT) END AS budget FROM (
          SELECT *, sum(CASE WHEN fits THEN cap END) OVER ({by}) AS cf, sum(CASE WHEN NOT fits THEN w END) OVER ({by}) AS wo FROM (
          SELECT *, CAST(cap AS HUGEINT) * w0 + CAST(c0 AS HUGEINT) * w <= CAST(budget AS HUGEINT) * w AS fits FROM (
          SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
            sum(w) OVER ({by} ORDER BY cap / w, {name} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w0 FROM {nodes}))))"""

    place = f"md5(concat_ws(':', '{plan.seed}', CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), '?')))"
    return f"""WITH m AS (SELECT doc_id, lang, source, CASE WHEN coalesce(regexp_extract(source, '([0-9]{{1,18}})$', 1), '') = '' THEN 'other'
        ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,18}})$', 1) AS BIGINT) % {plan.domains} AS VARCHAR) END AS domain,
        coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) AS t FROM {docs}),
      leaf AS (SELECT domain, lang, source, CAST(sum(t) AS BIGINT) AS supply FROM m GROUP BY ALL),
      d0 AS (SELECT domain, CAST(sum(supply) * {plan.max_epochs} AS BIGINT) AS cap, {case("domain", plan.domain_weights)} AS w,
        (SELECT CAST(sum(supply) * {plan.numerator} // {plan.denominator} AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain),
      d AS (SELECT * FROM {share("d0", "", "domain")}),
      l0 AS (SELECT domain, lang, CAST(sum(supply) * {plan.max_epochs} AS BIGINT) AS cap, {case("lang", plan.lang_weights)} AS w, any_value(budget) AS budget FROM leaf JOIN d USING (domain) GROUP BY domain, lang),
      l AS (SELECT * FROM {share("l0", "domain", "lang")}),
      s0 AS (SELECT leaf.domain, leaf.lang, source, supply, supply * {plan.max_epochs} AS cap, {plan.other} AS w, budget FROM leaf JOIN l ON leaf.domain = l.domain AND leaf.lang IS NOT DISTINCT FROM l.lang),
      s AS (SELECT * FROM {share("s0", "domain, lang", "source")}),
      q AS (SELECT *, CASE WHEN supply > 0 THEN budget - whole * supply ELSE -1 END AS part FROM (SELECT *, CASE WHEN supply > 0 THEN least(budget // supply, {plan.max_epochs}) ELSE 1 END AS whole FROM s)),
      p AS (SELECT m.*, whole, part, sum(t) OVER (PARTITION BY m.domain, m.lang, m.source ORDER BY {place} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM m JOIN q ON m.domain = q.domain AND m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source),
      n AS (SELECT *, whole + CASE WHEN whole < {plan.max_epochs} AND upto <= part THEN 1 ELSE 0 END AS n FROM p)
      SELECT doc_id, domain, lang, source, CAST(t AS BIGINT) AS mix_tokens, CAST(e AS INTEGER) AS epoch FROM n, LATERAL (SELECT unnest(range(n)) AS e)"""


def url_sql() -> str:
    listed = ", ".join(f"('{d}')" for d in url_filter.DOMAINS)
    host = "regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*')), ':[0-9]*$', ''), '^www[.]', '')"
    return f"""WITH p AS (SELECT page_id, url, {host} AS host FROM pages), l(entry) AS (VALUES {listed}),
      m AS (SELECT page_id, arg_max(entry, length(entry)) AS entry FROM p, l WHERE host = entry OR ends_with(host, '.' || entry) GROUP BY page_id)
      SELECT p.page_id, p.url, m.entry IS NOT NULL AS blocked, m.entry AS entry FROM p LEFT JOIN m USING (page_id)"""


TOPK_SQL = """SELECT vec_id, rank, neighbor_id, round(score, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 10"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_url_filter": op2_url_filter,
    "op3_compression_score": op3_compression_score,
    "op4_source_mix": op4_source_mix,
    "op5_shared_passages": op5_shared_passages,
    "op6_topk_search": op6_topk_search,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_resampling": op9_quality_resampling,
    "op10_ngram_join": op10_ngram_join,
}
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_sql(),
    "op6_topk_search": TOPK_SQL,
    "op4_source_mix": mix_sql(),
    "op7_exact_dedup": """SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text
        UNION ALL SELECT doc_id, NULL, 1 FROM documents WHERE text IS NULL""",
}
