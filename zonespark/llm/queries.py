"""The registered queries of the subpackage and the SQL they are checked against."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonespark.llm.collocations import collocations
from zonespark.llm.cotraining import score_quality
from zonespark.llm.html_text import extract_text
from zonespark.llm.mixing import pfair_mix
from zonespark.llm.packing import pack_documents
from zonespark.llm.private_data import BASE, private_data
from zonespark.llm.quality_rules import quality_rules
from zonespark.llm.ranked_search import ranked_search
from zonespark.llm.secrets import scan_secrets
from zonespark.llm.simhash import near_duplicates
from zonespark.llm.topk import top_k
from zonespark.llm.url_filter import filter_urls
from zonespark.llm.warc import archived


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix(_table(spark, sf_dir, "documents")).rows


def op7_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages")).drop("score")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data(_table(spark, sf_dir, "documents"))

    def written(spans: Column) -> Column:
        each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    def of(*kinds: str) -> Column:
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    base = of(*BASE)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id", *counts, (F.size("found") - F.size(base)).cast("long").alias("n_added"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"),
    )


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_curve_packing": op1_curve_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_template_text": op4_template_text,
    "op5_quality_rules": op5_quality_rules,
    "op6_pfair_mix": op6_pfair_mix,
    "op7_segment_topk": op7_segment_topk,
    "op8_cotrained_quality": op8_cotrained_quality,
    "op9_url_filter": op9_url_filter,
    "op10_warc_archive": op10_warc_archive,
    "op11_ranked_search": op11_ranked_search,
    "op12_private_data": op12_private_data,
    "op13_phrase_mining": op13_phrase_mining,
}

ORACLES: dict[str, str] = {
    "op7_segment_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), u AS (
            SELECT r, vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM v
        ), bad AS (
            SELECT DISTINCT r FROM u WHERE x IS NULL OR isnan(x) OR isinf(x)
        ), e AS (
            SELECT r, vec_id, i, floor(256 * x) AS x FROM u WHERE r NOT IN (SELECT r FROM bad)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, c.r, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM (SELECT * FROM e WHERE vec_id % 50 = 0) q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
            GROUP BY q.vec_id, c.vec_id, c.r
        ), o AS (
            SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 5
    """,
    "op10_warc_archive": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op11_ranked_search": """
        WITH t AS (
            SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), tf AS (
            SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL
        ), docs AS (
            SELECT d, sum(tf) AS n FROM tf GROUP BY d
        ), total AS (
            SELECT count(*) AS N, sum(n) AS L FROM docs
        ), m AS (
            SELECT d, 100 - 75 + CAST((75 * docs.n * total.N) // total.L AS BIGINT) AS m FROM docs, total
        ), w AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(total.N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term
        ), q AS (
            SELECT item_id, term, count(*) AS c FROM (
                SELECT item_id, unnest(regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark
            ) GROUP BY ALL
        ), s AS (
            SELECT item_id, d, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (d) GROUP BY ALL
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
    """,
    "op13_phrase_mining": """
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
        ), p AS (
            SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
        ), s AS (
            SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM p
        ), g AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM s, (VALUES (1), (2), (3), (4)) AS lengths(k)
        ), f AS (
            SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
        ), n AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (
            SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30
        ), held AS (
            SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c l ON l.lang = s.lang AND l.m > s.m
            AND contains(' ' || l.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * l.a >= 80 * s.a
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, k.k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
            FROM c ANTI JOIN held ON c.lang = held.lang AND c.phrase = held.phrase
            JOIN (VALUES (1), (2), (3)) AS k(k) ON k.k < c.m
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k.k], ' ')
            JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k.k + 1:], ' ')
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        )
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN n USING (lang)
        WHERE rank <= 2000
    """,
}
