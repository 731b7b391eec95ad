"""Filter, split, sample and mixture queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.operators import ordering, rules, sampling
from seamline.session import table, texts

RATIOS = {"train": 3, "valid": 1, "test": 1}
WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
DIGEST_MOD = "CAST(('0x' || md5(CAST({0} AS VARCHAR)))::UHUGEINT % 1000 AS BIGINT)"


def q07_language_filter_summary(spark, sf: str) -> DataFrame:
    return rules.keep_summary(table(spark, sf, "documents"), "lang", "en")


def q07_language_filter_rows(spark, sf: str) -> DataFrame:
    return rules.keep_value(table(spark, sf, "documents"), "lang", "EN ").select("doc_id", "lang", "source")


def q08_first_n_samples(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return ordering.rows_of_first_keys(e, "user_id", "event_id", 50).select("event_id", "user_id", "event_type")


def q09_reject_reasons(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    chain = [
        ("language", ~F.col("lang").isin("en", "de", "fr")), ("source", F.col("source").isin("src3", "src7")), ("too_short", F.col("n_chars") < 200),
        ("too_long", F.col("n_chars") > 10_000), ("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1),
    ]
    return rules.reason_counts(d, chain)


def q10_stable_hash_split(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", sampling.md5_mod(F.col("doc_id")).alias("bucket"), sampling.stable_split(F.col("doc_id")).alias("split"))


def q11_bottom_k_by_digest(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return sampling.bottom_k(d, F.md5("text"), "doc_id", 5, ["lang"]).select("lang", "rank", "doc_id", "digest")


def q12_balanced_split(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.balanced(d, "lang", "doc_id", F.md5(F.col("doc_id").cast("string")), RATIOS).select("lang", "doc_id", "split")


Q12_SQL = """
WITH n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM documents GROUP BY lang)),
r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank FROM documents),
c AS (SELECT n, n * 3 // 5 AS a, n // 5 AS b, n * 3 % 5 AS ra, n % 5 AS rb FROM n),
d AS (SELECT n, a, b, n - a - 2 * b AS rest, ra, rb FROM c),
e AS (SELECT n, a + CASE WHEN (CASE WHEN rb > ra THEN 2 ELSE 0 END) < rest THEN 1 ELSE 0 END AS a, b + CASE WHEN (CASE WHEN ra >= rb THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS b FROM d)
SELECT lang, doc_id, CASE WHEN rank <= a THEN 'train' WHEN rank <= a + b THEN 'valid' ELSE 'test' END AS split FROM r, e WHERE rank <= n
"""


def q13_equidistant_sample(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    return sampling.equidistant_rows(d, ["doc_id"], 37).select("ordinal", "doc_id")


Q13_SQL = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents)
SELECT ordinal, doc_id FROM r WHERE ordinal IN (SELECT CAST(round_even(i * ((SELECT max(n) FROM r) - 1) / 36.0, 0) AS BIGINT) FROM range(37) AS t(i))
"""


def q14_round_robin_strata(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return ordering.round_robin(d, ["lang", "source"], "doc_id", 200).select("doc_id", "lang", "source", "position")


Q14_SQL = """
WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY lang, source) AS first FROM documents),
p AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY turn, first, doc_id) AS position FROM t)
SELECT * FROM p WHERE position <= 200
"""


def q15_cap_per_group(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    return ordering.cap_per_group(d, ["source"], ["doc_id"], 20).select("source", "doc_id", "rank")


def q16_doc_grouped_split(spark, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    s = ordering.last_keys_split(c, "conv_id", F.struct("conv_id", "turn"), 10)
    return s.groupBy("conv_id", "split").agg(F.count("*").alias("n_turns"))


def q17_largest_remainder(spark, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return sampling.allocate(g, "n", 100, "lang")


Q17_SQL = """
WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT *, sum(n) OVER () AS t FROM g),
w AS (SELECT *, CAST(n * 100 // t AS BIGINT) AS whole, n * 100 % t AS rest FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, lang) AS rank, 100 - sum(whole) OVER () AS spare FROM w)
SELECT lang, n, whole + CASE WHEN rank <= spare THEN 1 ELSE 0 END AS share FROM r
"""


def q18_dedup_first(spark, sf: str) -> DataFrame:
    return sampling.dedup_first(table(spark, sf, "documents"), [F.md5("text")], "doc_id").select("doc_id", "copies")


def q19_decontaminate_anti_join(spark, sf: str) -> DataFrame:
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return sampling.anti_join_text(d, b, X.overlap_text(F.col("text")), X.overlap_text(F.col("text"))).select("doc_id")


Q19_SQL = r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
b AS (SELECT trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM benchmark)
SELECT doc_id FROM n WHERE t NOT IN (SELECT t FROM b)
"""


def q20_mixture(spark, sf: str) -> DataFrame:
    """200 documents by language weights and 50 pages, tagged by role, in a seeded order."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    primary = sampling.sample_by_view(docs, "lang", "id", WEIGHTS, 200, 7)
    extra = sampling.sample_rows(table(spark, sf, "pages").select(F.col("page_id").alias("id")), "id", 50, 7)
    return sampling.mixture(primary, extra, "id", 7).select("id", "lang", "mixture_role", "draw")


Q20_SQL = """
WITH w(lang, share, o) AS (VALUES ('en', 80, 0), ('de', 40, 1), ('fr', 40, 2), ('es', 40, 3)),
r AS (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS rank FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')),
p AS (SELECT id, lang FROM r JOIN w USING (lang) ORDER BY CASE WHEN rank > share THEN 1 ELSE 0 END, o, rank LIMIT 200),
a AS (SELECT page_id AS id FROM pages ORDER BY md5('7|' || page_id), page_id LIMIT 50)
SELECT id, lang, 'primary' AS mixture_role, md5('7|primary:' || id) AS draw FROM p UNION ALL SELECT id, NULL, 'auxiliary', md5('7|auxiliary:' || id) FROM a
"""


def q21_length_summary(spark, sf: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", " ", -1), lambda w: w != ""))
    d = table(spark, sf, "documents").select("lang", n.alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("n_rows"), F.round(F.avg("n"), 6).alias("avg_tokens"), F.min("n").cast("long").alias("min_tokens"), F.max("n").cast("long").alias("max_tokens"))


def q22_top_k_tags(spark, sf: str) -> DataFrame:
    words = texts(spark, sf).select(F.explode(F.split(F.lower("text"), " ", -1)).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


QUERIES = {f.__name__: f for f in (
    q07_language_filter_summary, q07_language_filter_rows, q08_first_n_samples, q09_reject_reasons, q10_stable_hash_split, q11_bottom_k_by_digest,
    q12_balanced_split, q13_equidistant_sample, q14_round_robin_strata, q15_cap_per_group, q16_doc_grouped_split, q17_largest_remainder,
    q18_dedup_first, q19_decontaminate_anti_join, q20_mixture, q21_length_summary, q22_top_k_tags,
)}
ORACLE_SQL = {
    "q07_language_filter_summary": "SELECT count(*) AS total, count(*) FILTER (WHERE lower(trim(lang)) = 'en') AS written, count(*) FILTER (WHERE lower(trim(lang)) <> 'en' AND trim(lang) <> '') AS skipped, count(*) FILTER (WHERE trim(coalesce(lang, '')) = '') AS missing FROM documents",
    "q07_language_filter_rows": "SELECT doc_id, lang, source FROM documents WHERE lower(trim(lang)) = 'en'",
    "q08_first_n_samples": "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY min(event_id), user_id LIMIT 50)",
    "q09_reject_reasons": "SELECT CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'language' WHEN source IN ('src3', 'src7') THEN 'source' WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 10000 THEN 'too_long' WHEN quality = 0 THEN 'low_quality' WHEN toxic = 1 THEN 'toxic' ELSE 'kept' END AS reason, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "q10_stable_hash_split": f"SELECT doc_id, {DIGEST_MOD.format('doc_id')} AS bucket, CASE WHEN {DIGEST_MOD.format('doc_id')} < 980 THEN 'train' ELSE 'valid' END AS split FROM documents",
    "q11_bottom_k_by_digest": "SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5(text), doc_id) AS rank, doc_id, md5(text) AS digest FROM documents) WHERE rank <= 5",
    "q12_balanced_split": Q12_SQL,
    "q13_equidistant_sample": Q13_SQL,
    "q14_round_robin_strata": Q14_SQL,
    "q15_cap_per_group": "SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 20",
    "q16_doc_grouped_split": "SELECT conv_id, CASE WHEN dense_rank() OVER (ORDER BY conv_id DESC) <= 10 THEN 'valid' ELSE 'train' END AS split, n_turns FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id)",
    "q17_largest_remainder": Q17_SQL,
    "q18_dedup_first": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)",
    "q19_decontaminate_anti_join": Q19_SQL,
    "q20_mixture": Q20_SQL,
    "q21_length_summary": "SELECT lang, count(*) AS n_rows, round(avg(n), 6) AS avg_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM (SELECT lang, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM documents) GROUP BY lang",
    "q22_top_k_tags": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 25",
}
