"""The queries of this subpackage: each operator over its whole table, and its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import documents

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(modulus: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import nearest

    return nearest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    out = substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.link(documents(spark, sf_dir).select("doc_id", "text"))


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.count_links(documents(spark, sf_dir).select("doc_id", "text"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_scoring

    return lm_scoring.score(documents(spark, sf_dir).select("doc_id", "text"), ~held_out(7), tokenizer_path(PIECES))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", *quality.FIELDS, "base_failed", "kept", "quality_score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = documents(spark, sf_dir).withColumn("held_out", held_out(4))
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    path = tokenizer_path(PIECES)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = pieces.encode(docs, path, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(documents(spark, sf_dir), tokenizer_path(), ids_too=False).drop("ids")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs)).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "format")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    out = line_dedup.remove_repeated_chunks(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_substring_dedup, op3_jaccard_join, op4_lm_scoring, op5_quality_rules, op6_language_id, op7_pieces, op8_packing, op9_secret_scan, op10_line_dedup, op3_jaccard_links)}
WORDS_SQL = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

ORACLES: dict[str, str] = {
    "op2_substring_dedup": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS ws FROM documents),
        windows AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS s FROM docs, unnest(range(1, len(ws) - 33)) AS t(i)),
        repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (s)),
        word AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
        kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r)""",
    "op3_jaccard_join": f"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        grams AS (SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM words),
        flat AS MATERIALIZED (SELECT doc_id, unnest(g) AS s, len(g) AS n FROM grams),
        links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY x, y, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id, doc_id AS r FROM grams UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r)
        SELECT g.doc_id, len(g)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id FROM grams g JOIN reach USING (doc_id) GROUP BY g.doc_id, g""",
    "op10_line_dedup": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
        hashed AS (SELECT *, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM docs),
        marked_lines AS (SELECT *, array_to_string(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN h[i] = h[i + 1] OR h[i + 1] = h[i + 2] OR (i > 1 AND h[i - 1] = h[i])
            OR ((CASE WHEN i > 2 THEN h[i - 2] ELSE 0 END * 31 + CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END) * 31 + h[i]) % 5 = 0 THEN '1' ELSE '0' END), '') AS m FROM hashed),
        thinned AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(m, '0{32}', repeat('0', 31) || '1', 'g'), '^1', '0'), '11', '10', 'g') AS m) FROM marked_lines),
        ends AS (SELECT *, list_filter(range(1, len(h) + 1), lambda i: i = len(h) OR m[i] = '1') AS e FROM thinned),
        parts AS (SELECT r, doc_id, k, array_to_string(ls[coalesce(e[k - 1] * (k > 1)::INT, 0) + 1:e[k]], chr(10)) AS body,
            e[k] - coalesce(e[k - 1] * (k > 1)::INT, 0) AS n,
            len(list_filter(ls[coalesce(e[k - 1] * (k > 1)::INT, 0) + 1:e[k]], lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS worded
            FROM ends, unnest(range(1, len(e) + 1)) AS t(k)),
        marked AS (SELECT *, worded >= 2 AND row_number() OVER (PARTITION BY body, worded >= 2 ORDER BY doc_id, k) > 1 AS gone FROM parts),
        kept AS (SELECT r, string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone) AS t, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS g FROM marked GROUP BY r)
        SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(g, 0)::BIGINT AS n_lines_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r)""",
}

_LINKS_SQL = f"""
    WITH words AS (SELECT doc_id, {WORDS_SQL.replace('text,', "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),")} AS ws FROM documents),
    grams AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM words),
    flat AS (SELECT doc_id, unnest(g) AS s, len(g) AS n FROM grams),
    links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id <> b.doc_id
        GROUP BY x, y, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*)))
    SELECT grams.doc_id, count(y)::BIGINT AS n_links FROM grams LEFT JOIN links ON x = grams.doc_id GROUP BY grams.doc_id"""
ORACLES["op3_jaccard_links"] = f"SELECT doc_id, n_shingles, component_id, n_links FROM ({ORACLES['op3_jaccard_join']}) JOIN ({_LINKS_SQL}) USING (doc_id)"
