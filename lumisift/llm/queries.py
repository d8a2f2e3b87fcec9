"""Queries over the text operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm import decontaminate, html_extract, hyperminhash, lexical_search, license_scan, merkle, mixing, personal_data, quality_fm, quality_rules, substring_dedup, suffix_dedup, toxicity

_SQL_WORDS = r"'[^\x20\x09-\x0D]+'"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("_chars_class", F.floor(F.log2(F.greatest("n_chars", F.lit(1)).cast("double"))))
    return quality_fm.score_documents(spark, docs, _labels(spark, sf_dir), meta_cols=("_chars_class",))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(spark, _docs(spark, sf_dir)).drop("broken")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds in ``spans``; keys and tokens, a kind of the method's own, in ``secrets``."""
    out = personal_data.find(spark, _docs(spark, sf_dir))
    listed = F.filter("spans", lambda x: x["kind"].isin(*personal_data.KINDS))
    out = out.withColumns({"listed": listed, "own": F.filter("spans", lambda x: ~x["kind"].isin(*personal_data.KINDS))})
    base = F.sha2(personal_data.spelled("base"), 256).alias("base_sha256")
    beyond = (F.size("listed") - F.size("base")).cast("long").alias("n_added")
    return out.select("doc_id", *(f"n_{k}" for k in personal_data.KINDS), base, personal_data.spelled("listed").alias("spans"), F.size("listed").cast("long").alias("n_spans"), beyond, personal_data.spelled("own").alias("secrets"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.score_documents(spark, docs, toxicity.fit(spark, docs, _labels(spark, sf_dir)))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(spark, _docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(spark, _docs(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "longest_common")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(spark, _docs(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(spark, _docs(spark, sf_dir), width=2)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, _docs(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark, _docs(spark, sf_dir), merkle.lowered_where_fifth())


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_quality_rules": op2_quality_rules,
    "op3_personal_data": op3_personal_data,
    "op4_toxicity": op4_toxicity,
    "op5_html_extract": op5_html_extract,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_hyperminhash": op9_hyperminhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_license_scan": op11_license_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE: dict[str, str] = {
    "op2_quality_rules": f"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source,
                   coalesce(text, '') AS text, coalesce(regexp_extract_all(text, {_SQL_WORDS}), []) AS words FROM documents),
        w AS (SELECT r, pos, array_to_string(words[pos:pos + 2], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS pos FROM d)),
        again AS (SELECT r, win FROM w GROUP BY r, win HAVING count(*) > 1),
        covered AS (SELECT r, count(DISTINCT at_pos) AS n FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS at_pos FROM w JOIN again USING (r, win)) GROUP BY r),
        line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
                 WHERE regexp_matches(line, {_SQL_WORDS}) GROUP BY r),
        c AS (SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
                     coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
              FROM d LEFT JOIN covered USING (r) LEFT JOIN line USING (r)),
        s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100e0 * n_symbols / greatest(n_words, 1) AS symbols,
                     100e0 * n_dup_lines / greatest(n_lines, 1) AS lines, 100e0 * n_repeat_words / greatest(n_words, 1) AS repeats,
                     word_chars / CAST(greatest(n_words, 1) AS DOUBLE) AS length FROM c),
        long AS (SELECT lang, source, rate, CASE WHEN v > 0 THEN ceil(ln(v) / ln(1.02e0)) END AS bin
                 FROM s UNPIVOT (v FOR rate IN (symbols, lines, repeats, length)) WHERE NOT base_failed),
        levels AS (SELECT 0 AS level, lang, source, rate, bin, count(*) AS n FROM long GROUP BY ALL
                   UNION ALL SELECT 1, lang, NULL, rate, bin, count(*) FROM long GROUP BY ALL
                   UNION ALL SELECT 2, NULL, NULL, rate, bin, count(*) FROM long GROUP BY ALL),
        cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin NULLS FIRST) AS upto,
                       sum(n) OVER (PARTITION BY level, lang, source, rate) AS total,
                       coalesce(2 * pow(1.02e0, bin) / (1 + 1.02e0), 0) AS v FROM levels),
        q AS (SELECT level, lang, source, rate, max(total) AS n, min(v) FILTER (upto >= ceil(total * 0.25)) AS q1, min(v) FILTER (upto >= ceil(total * 0.75)) AS q3
              FROM cum GROUP BY ALL),
        pick AS (SELECT a.lang, a.source, a.rate, CASE WHEN a.n >= 50 THEN a.q1 WHEN b.n >= 50 THEN b.q1 ELSE g.q1 END AS q1,
                        CASE WHEN a.n >= 50 THEN a.q3 WHEN b.n >= 50 THEN b.q3 ELSE g.q3 END AS q3,
                        CASE a.rate WHEN 'symbols' THEN 2e0 WHEN 'length' THEN 0.5e0 ELSE 5e0 END AS least
                 FROM (FROM q WHERE level = 0) a JOIN (FROM q WHERE level = 1) b ON a.lang = b.lang AND a.rate = b.rate JOIN (FROM q WHERE level = 2) g ON a.rate = g.rate),
        fence AS (SELECT lang, source, rate, q3 + 3 * greatest(q3 - q1, least) AS high, CASE WHEN rate = 'length' THEN q1 - 3 * greatest(q3 - q1, least) END AS low FROM pick),
        wide AS (SELECT lang, source, max(high) FILTER (rate = 'symbols') AS hs, max(high) FILTER (rate = 'lines') AS hl, max(high) FILTER (rate = 'repeats') AS hr,
                        max(high) FILTER (rate = 'length') AS hw, max(low) FILTER (rate = 'length') AS lw FROM fence GROUP BY ALL)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce(symbols > hs OR lines > hl OR repeats > hr OR length > hw OR length < lw, FALSE) AS kept
        FROM s LEFT JOIN wide USING (lang, source)""",
    "op6_substring_dedup": f"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_SQL_WORDS}), []) AS words FROM documents),
        w AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 12], ' ') AS win
              FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d)),
        least AS (SELECT win, min(doc_id) AS owner FROM w GROUP BY win HAVING count(*) > 1),
        gone AS (SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 13)))) AS spots
                 FROM w JOIN least USING (win) WHERE owner < doc_id GROUP BY doc_id),
        k AS (SELECT d.doc_id, len(words) AS n_words, coalesce(len(spots), 0) AS n_removed,
                     CASE WHEN spots IS NULL THEN words
                          ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(spots, i)), lambda i: words[i]) END AS kept
              FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op11_license_scan": license_scan.sql(),
    "op12_merkle_manifest": """
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
        d AS (
            SELECT doc_id, source, text, CASE WHEN xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT)),
                       lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 5 = 0
                   THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS hurt,
                   list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')), lambda a, b: a || b) AS head
            FROM documents, crc),
        l AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(hurt) || ':' || hurt, '-')) AS fold FROM d),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS size,
                   dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM l),
        tree AS (
            SELECT 0 AS level, s, i, size, leaf AS digest FROM leaves
            UNION ALL
            SELECT level + 1, s, i // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM tree WHERE size > 1 GROUP BY level, s, i // 16, size),
        subroots AS (SELECT s, digest AS subroot, count(*) OVER () AS n FROM tree WHERE size = 1),
        over_tree AS (
            SELECT 0 AS level, s AS i, n AS size, subroot AS digest FROM subroots
            UNION ALL
            SELECT level + 1, i // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM over_tree WHERE size > 1 GROUP BY level, i // 16, size),
        runs AS (
            SELECT 0 AS part, level, s, i // 16 AS run, list(digest ORDER BY i) AS kids FROM tree WHERE size > 1 GROUP BY level, s, i // 16
            UNION ALL
            SELECT 1, level, 0, i // 16, list(digest ORDER BY i) FROM over_tree WHERE size > 1 GROUP BY level, i // 16),
        climb AS (
            SELECT doc_id, leaf, s, CASE WHEN size = 1 THEN 1 ELSE 0 END AS part, 0 AS level, CASE WHEN size = 1 THEN s ELSE i END AS i,
                   CASE WHEN size = 1 THEN n ELSE size END AS size, n, fold, '' AS proof FROM leaves JOIN subroots USING (s)
            UNION ALL
            SELECT doc_id, leaf, c.s, CASE WHEN up THEN 1 ELSE part END, CASE WHEN up THEN 0 ELSE level + 1 END, CASE WHEN up THEN c.s ELSE run END,
                   CASE WHEN up THEN n ELSE (size + 15) // 16 END, n, sha256(before || fold || after), proof || before || after
            FROM (SELECT c.doc_id, c.leaf, c.s, c.part, c.level, r.run, c.size, c.n, c.fold, c.proof, c.part = 0 AND c.size <= 16 AS up,
                         array_to_string(kids[1:c.i % 16], '') AS before, array_to_string(kids[c.i % 16 + 2:], '') AS after
                  FROM climb c JOIN runs r ON r.part = c.part AND r.level = c.level AND r.run = c.i // 16 AND (c.part = 1 OR r.s = c.s) WHERE c.size > 1) c)
        SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = digest AS verified
        FROM climb c JOIN subroots USING (s) JOIN over_tree o ON o.size = 1 WHERE c.part = 1 AND c.size = 1""",
    "op13_lexical_search": r"""
        WITH t AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS terms FROM documents),
        i AS (
            SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        asked AS (SELECT k, item_id, term, count(*) AS times FROM i GROUP BY ALL),
        corpus AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM t WHERE len(terms) > 0),
        held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM t) SEMI JOIN asked USING (term) GROUP BY ALL),
        weight AS (SELECT term, CAST(floor(1000 * ln((2e0 * big_n + 2) / (2e0 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY term, big_n),
        scored AS (
            SELECT k, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
            FROM asked JOIN held USING (term) JOIN weight USING (term), corpus GROUP BY k, item_id, r, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        QUALIFY rank <= 20""",
}
