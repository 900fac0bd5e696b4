"""The queries of this folder by name, over the stored tables, and SQL for those it can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comandix.llm import caps, language, licenses, manifest, minhash, mixing, ordinal, pieces, quality_rules, suffix, url_rules, warc, whitening
from comandix.llm.common import read

#: A SentencePiece model that the driver can read.
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=4)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages are those of the documents with their number."""
    labels = read(spark, sf_dir, "labels")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic")) == 1
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("_bad")).select("doc_id", F.when(F.col("_bad"), "block").otherwise("allow").alias("label"))
    return url_rules.judged(read(spark, sf_dir, "pages"), known)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_pieces", "ids_sha256", "decoded_sha256", "round_trip")
    return pieces.encode_decode(read(spark, sf_dir, "documents"), PIECE_MODEL, outputs)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good."""
    labels = read(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.groupBy("doc_id").agg(F.min(grade).alias("grade"))
    return ordinal.graded(read(spark, sf_dir, "documents"), rated)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a text stands in ``text``, as in ``documents``; n_bytes is the size before."""
    return suffix.remove_repeats(read(spark, sf_dir, "documents"), 400, with_text=True).withColumnRenamed("kept_text", "text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf_dir, "documents")).drop("_k", "_often")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents")).drop("_k", "source")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(read(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = warc.write_archives(read(spark, sf_dir, "pages"))
    return warc.read_archives(folder, files).drop("payload", "file")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents")).drop("spans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(read(spark, sf_dir, "documents"), manifest.lowered_thirds)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's exact deviation as a long; NULL from 2**63 on, which about 10 million vectors reach."""
    white = whitening.whitened(read(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mix": op7_source_mix,
    "op8_language_id": op8_language_id,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_warc": op10_warc,
    "op11_license_scan": op11_license_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: What the rules for words and lines look like in SQL.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Lower-case words of license notices, and the templates and phrases as rows.
_NOTICE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_INDEX = licenses.Templates(licenses.TEMPLATES, licenses.PHRASES, licenses.THRESHOLD)
_TEMPLATES = ", ".join(
    f"('{label}', {step}, {least}, {[_INDEX.vocabulary[w] for w in words]})"
    for label, step, least, words in zip(_INDEX.labels, _INDEX.steps, _INDEX.least, _INDEX.sets)
)
_PHRASES = ", ".join(f"({[_INDEX.vocabulary[w] for w in words]}, '{label}')" for words, label in _INDEX.phrases)

ORACLE: dict[str, str] = {
    "op6_quality_rules": rf"""
WITH base AS (
    SELECT doc_id, source, text, {_WORDS} AS w,
        md5(concat_ws(chr(31), coalesce('=' || doc_id, '-'), coalesce('=' || source, '-'), coalesce('=' || text, '-'))) AS k,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
repeated AS (
    SELECT doc_id, sum(least(5, coalesce(next - i, 5))) AS n_repeat_words
    FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice WHERE n > 1) GROUP BY doc_id),
line AS (
    SELECT k, doc_id, source, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS h, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT k, doc_id, source, unnest(lines) AS x FROM base)),
often AS (
    SELECT source, h, min({{'none': doc_id IS NULL, 'id': doc_id, 'k': k}}).k AS first FROM line
    GROUP BY source, h HAVING count(DISTINCT k) > {quality_rules.LEAST_DOCUMENTS}),
gone AS (
    SELECT k, sum(n) AS n_frequent_words FROM line JOIN often ON line.source IS NOT DISTINCT FROM often.source AND line.h = often.h
    WHERE k <> first GROUP BY k),
figures AS (
    SELECT base.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_frequent_words, 0) AS BIGINT) AS n_frequent_words
    FROM base LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (k)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - n_frequent_words AS rest FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words, base_failed,
    NOT base_failed AND NOT (n_frequent_words > 0 AND (rest < {quality_rules.LEAST_WORDS} OR rest < {quality_rules.LEAST_PART} * n_words)) AS kept
FROM judged""",
    "op7_source_mix": rf"""
WITH rows AS (
    SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
        md5(concat_ws(chr(31), coalesce('=' || doc_id, '-'), coalesce('=' || source, '-'), coalesce('=' || text, '-'))) AS k FROM documents),
keyed AS (SELECT *, md5(k || ':1') AS r FROM rows),
sources AS (
    SELECT source, sum(size)::DOUBLE AS s, (ARRAY[5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM rows GROUP BY source),
ordered AS (
    SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM sources),
level AS (SELECT min_by(rest / others, 3 * s / w) AS share FROM ordered WHERE rest / others <= 3 * s / w),
target AS (SELECT source, CAST(s AS BIGINT) AS source_size, least(3 * s, coalesce(share, 0) * w) AS target FROM ordered, level),
budget AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS times FROM target),
placed AS (
    SELECT doc_id, size, source_size, target, times, CAST(round(target) AS BIGINT) - times * source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY keyed.source ORDER BY r, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM keyed JOIN budget ON keyed.source IS NOT DISTINCT FROM budget.source)
SELECT doc_id, size, source_size, target, CAST(size * times + least(size, greatest(0, rest - start)) AS BIGINT) AS taken FROM placed""",
    "op9_embedding_near_dedup": r"""
WITH RECURSIVE fine AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.vec_id AND reach.c < links.b),
component AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, c = e.vec_id AS kept
FROM embeddings e JOIN component ON component.vec_id = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
    CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, url
FROM f""",
    "op11_license_scan": rf"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {_NOTICE_WORDS} AS w FROM documents),
places AS (
    SELECT k, label, i FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM docs) JOIN (VALUES {_PHRASES}) p(head, label)
        ON w[i] = head[1] AND w[i:i + len(head) - 1] = head),
base AS (
    SELECT k, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM places GROUP BY k),
template AS (SELECT * FROM (VALUES {_TEMPLATES}) t(label, step, least, held)),
blocks AS (
    SELECT k, step, list_distinct(w[a + 1:a + 2 * step]) AS b FROM (
        SELECT k, w, step, unnest(range(0, greatest(1, len(w) - step), step)) AS a FROM docs, (SELECT DISTINCT step FROM template))),
met AS (
    SELECT k, label, n / len(held) AS part FROM (
        SELECT k, label, least, held, len(list_intersect(b, held)) AS n FROM blocks JOIN template USING (step) WHERE len(b) >= least) WHERE n >= least),
all_labels AS (
    SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS part
    FROM (SELECT k, label, 1.0::DOUBLE AS part FROM places UNION ALL SELECT k, label, part FROM met) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(part, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN base USING (k) LEFT JOIN all_labels USING (k)""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE crc AS (
    SELECT doc_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT),
        lambda c, b: list_reduce([xor(c, b)] || repeat([0::BIGINT], 8), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 3 = 0 AS hit
    FROM (SELECT DISTINCT doc_id FROM documents)),
shown AS (
    SELECT d.doc_id, lang, array_to_string(list_transform([CAST(d.doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
        lambda x: coalesce(strlen(x) || ':' || x, '-')), '') AS head, text,
        CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now
    FROM documents d JOIN crc ON d.doc_id IS NOT DISTINCT FROM crc.doc_id),
leaf AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS d, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS bent FROM shown)),
tree AS (
    SELECT lang, 0 AS l, i, d, n FROM leaf
    UNION ALL SELECT lang, l + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 7) // 8) FROM tree WHERE n > 1 GROUP BY lang, l, i // 8),
subroots AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS l, i, d, n FROM subroots
    UNION ALL SELECT l + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY l, i // 8),
nodes AS (
    SELECT false AS up, lang, l, i, d FROM tree WHERE n > 1 UNION ALL SELECT true, NULL, l, i, d FROM top WHERE n > 1),
sides AS (
    SELECT a.up, a.lang, a.l, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS below,
        coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS later
    FROM nodes a JOIN nodes b ON a.up = b.up AND a.lang IS NOT DISTINCT FROM b.lang AND a.l = b.l AND a.i // 8 = b.i // 8 GROUP BY a.up, a.lang, a.l, a.i),
steps AS (
    SELECT leaf.i AS place, leaf.lang, false AS up, l, below, later FROM leaf JOIN sides ON NOT up AND leaf.lang IS NOT DISTINCT FROM sides.lang AND sides.i = leaf.i // CAST(8 ** l AS BIGINT)
    UNION ALL SELECT leaf.i, leaf.lang, true, l, below, later FROM leaf JOIN subroots s ON leaf.lang IS NOT DISTINCT FROM s.lang JOIN sides ON up AND sides.i = s.i // CAST(8 ** l AS BIGINT)),
path AS (
    SELECT place, lang, sha256(string_agg(below || later, '' ORDER BY up, l)) AS proof, list({'b': below, 'a': later} ORDER BY up, l) AS way FROM steps GROUP BY place, lang),
checked AS (
    SELECT leaf.doc_id, leaf.d AS leaf, s.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
        list_reduce([{'b': bent, 'a': ''}] || coalesce(way, []), lambda x, y: {'b': sha256(y.b || x.b || y.a), 'a': ''}).b AS folded_root
    FROM leaf JOIN subroots s ON leaf.lang IS NOT DISTINCT FROM s.lang LEFT JOIN path ON path.place = leaf.i AND path.lang IS NOT DISTINCT FROM leaf.lang)
SELECT *, folded_root = root AS verified FROM checked""",
}
