"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html_text, langid, pii, quality, simhash, toxicity, urls
from ._common import is_held_out, sha_hex, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def chat_log(rows: DataFrame) -> DataFrame:
    """An event log of finished rows (conv_id, turn, role, text), as a service would have kept it: assistant texts are streamed
    in two deltas, user texts of every third turn are edited once, and the last assistant text of every fifth conversation is
    a regeneration, which drops a message that came before it."""
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    r = rows.withColumn("m", at).withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("m"))).over(W.partitionBy("conv_id")))
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    event = lambda n, kind, what, more=F.col("m"): F.struct((F.col("m") * 10 + n).alias("seq"), more.alias("msg_id"), F.lit(kind).alias("kind"), what.alias("text"))
    streamed = [event(1, "delta", F.substring(text, F.lit(1), half)), event(2, "delta", F.substring(text, half + 1, F.length(text)))]
    again = (F.col("m") == F.col("last")) & (F.pmod("conv_id", F.lit(5)) == 4)
    log = (
        F.when(again, F.array(event(0, "message", F.lit("first draft")), event(3, "message", F.lit("dropped"), -F.col("m")), event(4, "regenerate", text)))
        .when(F.col("role") == "assistant", F.array(event(0, "message", F.lit("")), *streamed))
        .when(F.col("m") % 3 == 0, F.array(event(0, "message", F.lit("typo")), event(1, "edit", text)))
        .otherwise(F.array(event(0, "message", text)))
    )
    return r.select("conv_id", "role", F.explode(log).alias("e")).select("conv_id", "e.seq", "e.msg_id", "e.kind", "role", "e.text")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    events = chat_log(rows.unionByName(probe))
    out = chat.format_events(events)
    whole = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), "formatted", "loss_mask")
    turns = chat.parse(whole)
    back = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("t")))), lambda x: x["t"]).alias("t"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("loss_text").isNotNull(), F.struct("at", "loss_text")))), lambda x: x["loss_text"]).alias("l"),
    )
    digest = back.select(
        "conv_id", "n_turns", sha_hex(F.array_join("t", "")).alias("turns_sha256"),
        F.length(F.array_join("l", "")).cast("long").alias("loss_chars"), sha_hex(F.array_join("l", "")).alias("loss_sha256"),
    )
    return digest.join(whole.select(F.col("conv_id").alias("__c"), "formatted_chars"), F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), esc AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'),
    '(<)(\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g') AS e FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 1 + length(e) + 8) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path, pattern = P.path(VOCABULARY), P.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, pattern).drop("text")
    back = bpe.decode(ids, path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha_hex(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), sha_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(groups: str) -> str:
    """The prior strength of a level, as in urls.py."""
    return f"""(SELECT round(coalesce(CASE WHEN rho > 0 THEN least(1000.0, greatest(1.0, 1 / rho - 1)) ELSE 1000.0 END, 1000.0), 6) AS k FROM (
      SELECT (q - N * p * p - (g - 1) * p * (1 - p)) / nullif(p * (1 - p) * (N - nn / nullif(N, 0) - (g - 1)), 0) AS rho FROM (
        SELECT count(*) AS g, sum(n) AS N, sum(x) / sum(n) AS p, sum(x * x / n) AS q, sum(n * n) AS nn FROM {groups} WHERE n > 0)))"""


OP2_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS rv
  FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path
), out AS (
  SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM parts LEFT JOIN labels ON doc_id = page_id
), hosts AS (
  SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS x, split_part(host, '.', -1) AS suffix,
    CASE WHEN len(string_split(host, '.')) < 2 THEN host ELSE split_part(host, '.', -2) || '.' || split_part(host, '.', -1) END AS domain FROM out GROUP BY host
), domains AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY ALL
), whole AS (SELECT coalesce(sum(x) / nullif(sum(n), 0), 0) AS m FROM suffixes
), k1 AS {_strength_sql("suffixes")}, k2 AS {_strength_sql("domains")}, k3 AS {_strength_sql("hosts")}
, s AS (SELECT suffix, (k * m + x) / (k + n) AS mean FROM suffixes, whole, k1
), d AS (SELECT suffix, domain, (k * s.mean + x) / (k + n) AS mean FROM domains JOIN s USING (suffix), k2
), h AS (SELECT host, k + n AS w, (k * d.mean + x) / (k + n) AS mean FROM hosts JOIN d USING (suffix, domain), k3
)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (host, path) JOIN h USING (host)
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: The key of the surrogates in the query and the pipeline; a real run passes its own.
PII_KEY = "segue"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", F.col("__n_entities").alias("n_entities"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.covered()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        sha_hex(F.array_join("item_ids", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents
), b AS (SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark
), bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks)
), hit AS (SELECT r, s, k, item_id FROM dw JOIN bw USING (k, win)
), places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM hit)) GROUP BY r
), ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN ids USING (r)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_simhash": op1_simhash, "op2_url_filter": op2_url_filter, "op3_language": op3_language, "op4_quality": op4_quality, "op5_html_text": op5_html_text, "op6_pii": op6_pii,
    "op8_decontaminate": op8_decontaminate, "op10_toxicity": op10_toxicity,
    "op7_chat_format": op7_chat_format, "op9_bpe": op9_bpe}
ORACLES = {"op2_url_filter": OP2_SQL, "op8_decontaminate": OP8_SQL, "op7_chat_format": OP7_SQL}
