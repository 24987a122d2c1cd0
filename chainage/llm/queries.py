"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainage.llm import licenses, middle, negatives, urlrules
from chainage.llm.common import fresh_dir, short_batches
from chainage.llm.common import table as read
from chainage.llm.secrets import RULES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return read(spark, sf_dir, name)


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.decontam import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.superkmer import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_permutation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.sharding import place

    shards = [f"shard-{i:04d}" for i in range(256)]
    return place(table(spark, sf_dir, "documents"), ["doc_id"], shards)


def op3_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chainage.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_web_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.webarchive import round_trip

    return round_trip(table(spark, sf_dir, "pages"), fresh_dir(spark, "op7"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.secrets import extend, report

    docs, folder = table(spark, sf_dir, "documents"), fresh_dir(spark, "op8")
    extend(docs, folder)
    # the next run over the same paths finds every blob in the ledger and scans nothing
    return report(docs, extend(docs, folder).findings)


def op11_url_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.urlrules import judge

    return judge(read(spark, sf_dir, "pages")).drop("tier")


def op12_ball_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.negatives import mine

    return mine(read(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainage.llm.middle import transform

    return transform(table(spark, sf_dir, "documents"), with_output=False, digests=True)


QUERIES = {f.__name__: f for f in (op1_simhash_pivots, op2_permutation_shards, op3_license_index, op4_toxic_lexicon, op5_multiprobe_neighbours, op6_tournament_packing, op7_web_packages, op8_secret_ledger, op9_benchmark_leaks, op10_super_kmer_dedup, op11_url_expressions, op12_ball_tree_negatives, op13_fill_in_middle)}



def _rule_sql(k: int, rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{p}', 0) AS x, regexp_extract_all(t, '{p}', {rule.group}) AS y, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')"


ORACLES = {
    "op3_license_index": licenses.oracle(),
    "op7_web_packages": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT *, list_aggregate([lpad(bin(('0x' || h[i:i])::INTEGER), 4, '0') FOR i IN range(1, 41)], 'string_agg', '') AS b,
                max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum([CAST(substr(b, 5 * g + k, 1) AS INTEGER) * (1 << (5 - k)) FOR k IN range(1, 6)]) AS INTEGER), 1) FOR g IN range(0, 32)], 'string_agg', '') AS payload_digest,
       CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM bits
""",
    "op8_secret_ledger": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (""" + " UNION ALL ".join(_rule_sql(k, r) for k, r in enumerate(RULES)) + r""")),
s AS (SELECT doc_id, k, kind, len(y[i]) >= least AS ok,
             CAST(list_sum([len(g) FOR g IN gaps[1:i]]) + list_sum([len(g) FOR g IN x[1:i]]) AS BIGINT) AS e, len(x[i]) AS n FROM m),
f AS (SELECT doc_id, k, kind || ':' || (e - n) || ':' || e AS span, e - n AS b FROM s WHERE ok),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(span, ',' ORDER BY b, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY b, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
""",
    "op10_super_kmer_dedup": """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
marked AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS d0 FROM windows),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS g
  FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM marked WHERE d0 < doc_id) GROUP BY doc_id),
kept AS (
  SELECT words.doc_id, w, [w[p] FOR p IN range(1, len(w) + 1) IF g IS NULL OR NOT list_contains(g, p)] AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
""",
    "op11_url_expressions": f"SELECT * EXCLUDE (tier) FROM ({urlrules.oracle()})",
    "op12_ball_tree_negatives": negatives.oracle(),
    "op13_fill_in_middle": middle.oracle(),
}
