"""The operators over their whole tables, with production parameters, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.llm import alignment, cotraining, decontaminate, mixing, piece_agenda, quality_rules, quotations, simhash, spelling, substrings, surrogates, token_planes, url_filter
from tremora.llm.common import table
from tremora.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def pieces_path() -> str:
    """The public merge-type SentencePiece model; a path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def tokenizer_path() -> str:
    """The public byte-level vocabulary; a path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_quality_rules")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "posterior")


@query("op3_token_planes")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-planes")
    token_planes.write_planes(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_planes.read_documents(spark, path)


@query("op4_decontamination")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_mixing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "pattern")


@query("op10_simhash")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


_SUBSTRING_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
windows AS (
    SELECT doc_id, p, word, CASE WHEN count(*) OVER ahead = 35 THEN md5(string_agg(word, ' ') OVER ahead) END AS win
    FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
twice AS (SELECT win FROM windows WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
marked AS (
    SELECT doc_id, p, word, max(CASE WHEN win IN (SELECT win FROM twice) THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM windows),
summed AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN summed USING (doc_id)
"""


@query("op6_substrings", _SUBSTRING_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


_URL_SQL = r"""
WITH RECURSIVE
parts AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
addressed AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query FROM parts),
rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
own AS (SELECT page_id, url, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS r_verdict
    FROM addressed, rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id, url),
formed AS (SELECT *, CASE WHEN instr(url, '://') > 0 THEN 'https://' || regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)[.]', '')
    || regexp_replace(path, '([.]html?|/+)$', '') || regexp_replace('?' || regexp_replace(regexp_replace('&' || query, '&(utm_[A-Za-z_]*|ref)=[^&]*', '', 'g'), '^&+', ''), '[?]$', '')
    ELSE url END AS form FROM addressed),
judged AS (SELECT f.page_id, f.url, f.host, f.path, f.form, o.rule, o.r_verdict FROM formed f LEFT JOIN own o ON f.page_id = o.page_id AND f.url = o.url),
shared AS (SELECT form, bool_or(r_verdict = 'allow') AS allowed, bool_or(r_verdict = 'block') AS blocked FROM judged GROUP BY form)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
    coalesce(r_verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN shared USING (form)
"""


@query("op8_url_filter", _URL_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op2_surrogates")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key of this check; a real one is the caller's secret
    return surrogates.replaced(table(spark, sf_dir, "documents"), b"check key")


@query("op5_cotraining")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")).alias("good"))
    return cotraining.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"), labels)


@query("op7_quotations")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.linked(table(spark, sf_dir, "conversations"))


@query("op12_pieces")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_agenda.encoded(table(spark, sf_dir, "documents"), pieces_path())
    return found.select(*piece_agenda.digests(found))


@query("op13_spelling")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op11_alignment")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path(), pieces_path()).documents()
