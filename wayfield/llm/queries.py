"""Registered queries of the numbered operators.

SQL is given for decontamination, line dedup, ranked search and collocations. For the
others hash functions, models, markup and tokenizers are beyond it; the tests hold each against a brute-force version, a round
trip or held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, html_extract, langid, line_dedup, quality_pu, quality_rules, ranked, secrets, sharding, simhash, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; ``und`` and 0 for null texts and texts without a letter. Ids may repeat or be null: each row gives one, null ids are held out of learning."""
    docs = table(spark, sf_dir, "documents")
    learn = langid.training_part()
    model = langid.fit(docs.filter(learn))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (~learn).alias("held_out"), "lang_pred", "score", "rejected")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by bytes; null texts have none, each repeated row takes a slot, an empty table gives no rows."""
    return sharding.shard(table(spark, sf_dir, "documents"), 24)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, one row a pair; null and empty texts hold none, repeated rows of an id count once."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; texts without words have fingerprint zero and are linked like any other, rows with null ids take part."""
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null and empty texts fail the base conditions, repeated rows each give one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.rate(docs, rules).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document; null texts are empty, each row gives one."""
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; null and empty texts are scored by zero statistics, each row gives one. Only ids of the learning part that are labelled 1 are learnt from, beside unlabelled texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = quality_pu.training_part()
    positives = table(spark, sf_dir, "labels").filter("quality = 1").filter(learn)
    model = quality_pu.fit(docs.filter(learn), positives)
    return quality_pu.scored(docs, model).select("doc_id", (~learn).alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with the sums at every length and context limit; null texts have length 0."""
    return token_counts.report(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found, one row each; null and empty texts have none, repeated rows give theirs again."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null pages are empty, broken markup is read as far as it goes."""
    return html_extract.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after those that many share are dropped; null texts have one empty line, each repeated row counts as a document."""
    left = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item; null and empty texts have no terms and aren't found."""
    return ranked.best(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of every language; null texts are empty, a null language is ``und``, repeated rows count each time."""
    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_sharding, op3_decontamination, op4_simhash, op5_quality_rules,
        op6_bpe, op7_quality_classifier, op8_token_counts, op9_secrets, op10_html_extraction,
        op11_line_dedup, op12_ranked_search, op13_collocations,
    )
}

#: Eleven of thirteen agreeing words hold three in a row, so alignments are found by equal word triples.
LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
 dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM d),
 bt AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p, len(w) AS n FROM b WHERE len(w) >= 9),
 d3 AS (SELECT *, lead(t) OVER o AS t1, lead(t, 2) OVER o AS t2 FROM dt WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
 b3 AS (SELECT *, lead(t) OVER o AS t1, lead(t, 2) OVER o AS t2 FROM bt WINDOW o AS (PARTITION BY item_id ORDER BY p)),
 shifts AS (SELECT DISTINCT d3.doc_id, b3.item_id, d3.p - b3.p AS shift FROM d3 JOIN b3 ON d3.t = b3.t AND d3.t1 = b3.t1 AND d3.t2 = b3.t2),
 words AS (SELECT s.doc_id, s.item_id, s.shift, bt.p AS q, bt.n, CAST(dt.t = bt.t AS INT) AS same FROM shifts s JOIN bt ON bt.item_id = s.item_id JOIN dt ON dt.doc_id = s.doc_id AND dt.p = bt.p + s.shift),
 sums AS (SELECT *, sum(same) OVER w13 AS a13, count(*) OVER w13 AS n13, sum(same) OVER alls AS a, count(*) OVER alls AS c FROM words
  WINDOW w13 AS (PARTITION BY doc_id, item_id, shift ORDER BY q ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), alls AS (PARTITION BY doc_id, item_id, shift)),
 hits AS (SELECT doc_id, item_id, q + shift AS place, a13 AS agreed, 13 AS words FROM sums WHERE n >= 13 AND n13 = 13 AND a13 >= 11
  UNION ALL SELECT doc_id, item_id, q + shift, a, n FROM sums WHERE n < 13 AND c = n AND a = n AND q = 0)
SELECT doc_id, item_id, CAST(place AS BIGINT) AS place, CAST(agreed AS INT) AS agreed, CAST(words AS INT) AS words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreed DESC, place) AS r FROM hits) WHERE r = 1
"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LINES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
 k AS (SELECT row, doc_id, i, line, trim({_LOWERED.replace("text", "line")}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
 s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3),
 m AS (SELECT k.*, s.last IS NOT NULL AND s.last IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY row, doc_id
"""
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED_SQL = rf"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
 n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
 c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
 q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
 f AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
 w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t),
 s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN n USING (doc_id), c GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10
"""
PHRASES_SQL = rf"""
WITH p AS (SELECT lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents)),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, range(1, 6) AS r(k) WHERE i + k - 1 <= len(w)),
 f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
 c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
 cuts AS (SELECT c.lang, c.phrase, c.f AS a, j.j, l.f AS l, r.f AS r, n.n, CAST((CAST(1000 AS HUGEINT) * c.f * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM c JOIN range(1, 5) AS j(j) ON j.j < c.k JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j.j], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j.j + 1:], ' ') JOIN n ON n.lang = c.lang),
 low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 parts AS (SELECT c.lang, array_to_string(c.w[i.i:i.i + m.m - 1], ' ') AS phrase, max(c.f) AS longer FROM c JOIN range(2, 5) AS m(m) ON m.m < c.k JOIN range(1, 5) AS i(i) ON i.i + m.m - 1 <= c.k GROUP BY ALL)
SELECT * FROM (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank, phrase, a, l, r, n, score FROM low LEFT JOIN parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a) WHERE rank <= 2000
"""
ORACLES: dict[str, str] = {"op3_decontamination": LEAKS_SQL, "op11_line_dedup": LINES_SQL, "op12_ranked_search": RANKED_SQL, "op13_collocations": PHRASES_SQL}
