"""The queries opN_<name> over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import lm_score

    return lm_score.score(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import packing

    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits whose places follow from its length and doc_id."""
    from stridelake.llm import tokencount

    docs = table(spark, sf_dir, "documents")
    size, turn = F.coalesce(F.length("text"), F.lit(0)), F.coalesce(F.col("doc_id"), F.lit(0)) % 7
    made = lambda seq, at, removed, text: F.struct(F.lit(seq).alias("seq"), at.cast("int").alias("at"), removed.cast("int").alias("removed"), F.lit(text).alias("inserted"))
    edits = F.array(
        made(1, size / 3, turn, "An inserted passage, it's new.\n"),
        made(2, size * 2 / 3, turn * 3, ""),
        made(3, size + turn, F.lit(0), " The end"),
    )
    counted = tokencount.recount(tokencount.trees(docs, tokenizer_path(), edits), tokenizer_path(), "extra_0")
    return counted.select("doc_id", "n_tokens", "n_after", "n_chars", "n_encoded")


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import warc

    back = warc.read_back(warc.normalise(warc.archives(table(spark, sf_dir, "pages"))))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import linededup

    kept = linededup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.md5("text").alias("kept_md5"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place where a benchmark item occurs."""
    from stridelake.llm import decontam

    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import suffix

    return suffix.digest(table(spark, sf_dir, "documents")).withColumn("kept_bytes", F.col("n_bytes") - F.col("n_removed"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import phrases

    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stridelake.llm import naming

    return naming.classes(table(spark, sf_dir, "documents")).drop("row")


QUERIES = {
    f.__name__: f
    for f in (op1_lm_score, op2_packing, op3_multi_index, op4_warc, op5_suffix, op6_jaccard, op7_tokencount, op8_linededup, op9_quality, op10_decontam, op11_phrases, op12_whitening, op13_naming)
}

# SQL where it can express the whole result.
ORACLE: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS h FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM f
    """,
    "op11_phrases": r"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t
            FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
        total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
        spot AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        gram AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM spot, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)),
        f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
        cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
        cut AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
        scored AS (
            SELECT c.lang, c.m, c.phrase, c.w, a, k, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score
            FROM cut c JOIN total t ON t.lang = c.lang
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 :], ' ')),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        size AS (SELECT unnest([2, 3, 4]) AS s),
        start AS (SELECT unnest([1, 2, 3, 4]) AS b),
        inner_ AS (
            SELECT lang, array_to_string(w[b : b + s - 1], ' ') AS phrase, max(a) AS longer
            FROM cand, size, start WHERE s < m AND b + s - 1 <= m GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
               a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM kept QUALIFY rank <= 2000
    """,
    "op13_naming": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST)
    """,
}
