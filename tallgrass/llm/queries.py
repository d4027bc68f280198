"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bpe, decontaminate, divergence, license, lm, mixing, quality, sharding, simhash, suffix, tokenfile, warc, whitening
from tallgrass.llm.common import table


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = license.scan(docs, *license.fit(docs))
    return found.select("doc_id", "n_paragraphs", "n_licenses", "n_unconfirmed", F.array_join("families", ",").alias("families"), "license", F.round("probability", 4).alias("probability"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    read = warc.read_warc(warc.write_warc(warc.plan_records(pages))).where("kind in ('response', 'revisit')")
    id_type = dict(pages.dtypes)["page_id"]
    own = F.col("kind") == "response"
    return read.select(  # ids stand behind urn:page:, and may hold colons themselves
        F.nullif(F.expr("substring(record_id, 10)"), F.lit("")).cast(id_type).alias("page_id"),
        F.when(own, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.expr("substring(refers_to, 10)").cast(id_type).alias("refers_to"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, packed = lm.train(table(spark, sf_dir, "documents"))
    return lm.score(packed, model)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_file())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = tokenfile.write_tokens(docs, vocabulary_file(), end_id=1, n_vocab=49408)
    read = tokenfile.read_documents(files, dict(docs.dtypes)["doc_id"])
    return read.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")  # characters that a span cuts are replaced here, not in the digest
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license": op1_license,
        "op2_decontamination": op2_decontamination,
        "op3_simhash": op3_simhash,
        "op4_warc": op4_warc,
        "op5_quality": op5_quality,
        "op6_lm_scores": op6_lm_scores,
        "op7_bpe": op7_bpe,
        "op8_token_files": op8_token_files,
        "op9_suffix_array": op9_suffix_array,
        "op10_sharding": op10_sharding,
        "op11_whitening": op11_whitening,
        "op12_mixing": op12_mixing,
        "op13_divergence": op13_divergence,
        "pipeline": pipeline,
    }


#: Words of texts for the SQL below: lower-case letters and digits and all that is not ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, len(w[s:s + 9]) AS n, array_to_string(w[s:s + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM docs CROSS JOIN (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, spots.n FROM spots JOIN wins ON wins.win = spots.win AND wins.n = spots.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""

_OP4 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM p LEFT JOIN f USING (d)"""

_OP5 = r"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS row FROM documents),
win AS (SELECT row, s, array_to_string(w[s:s + 2], ' ') AS x FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS s FROM t WHERE len(w) >= 3)),
rep AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(s, s + 3)) AS p FROM (SELECT row, s, count(*) OVER (PARTITION BY row, x) AS c FROM win) WHERE c > 1) GROUP BY 1),
m AS (SELECT row, doc_id, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM t LEFT JOIN rep USING (row)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words OR 10 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS soft FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft)::DOUBLE AS f FROM j GROUP BY 1),
a AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS n, count(*)::DOUBLE AS k, sum(f * f / n) / sum(n) AS s2 FROM h),
b AS (SELECT mean, s2 - mean * mean - mean * (1 - mean) * k / n AS spread, n / k AS size FROM a),
c AS (SELECT mean, least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE size END, 1), 1e6) AS size FROM b),
v AS (SELECT source, (f + greatest(mean, 1e-6) * size) / (n + greatest(mean, 1e-6) * size + greatest(1 - mean, 1e-6) * size) > 0.5 AS bad FROM h CROSS JOIN c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (bad AND soft) AS kept FROM j JOIN v ON v.source IS NOT DISTINCT FROM j.source"""


_OP12 = r"""WITH d AS (SELECT doc_id, source IS NULL AS ns, coalesce(source, '') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
a AS (SELECT ns, s, CAST(sum(size) AS BIGINT) AS z, (row_number() OVER (ORDER BY ns, s) - 1) % 3 + 1 AS w FROM d GROUP BY 1, 2),
r AS (SELECT *, (3 * z)::DOUBLE / w::DOUBLE AS reach FROM a),
f AS (SELECT *, row_number() OVER o AS k, (sum(z) OVER () - coalesce(sum(3 * z) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
  (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS open FROM r WINDOW o AS (ORDER BY reach, ns, s)),
l AS (SELECT k AS lk, rest AS lr, open AS lo FROM f WHERE rest * w <= 3 * z * open ORDER BY k LIMIT 1),
t AS (SELECT ns, s, z, k < lk AS filled, CASE WHEN k < lk THEN (3 * z)::DOUBLE ELSE lr * w / lo END AS target FROM f CROSS JOIN l),
e AS (SELECT *, CASE WHEN z = 0 THEN 0 WHEN filled THEN 3 * 1073741824 ELSE CAST(floor(target / z::DOUBLE * 1073741824.0::DOUBLE) AS BIGINT) END AS e FROM t),
g AS (SELECT doc_id, size, z, target, e, ('0x' || substr(md5('42:' || s), 1, 8))::BIGINT // 4 + e * (row_number() OVER (PARTITION BY ns, s ORDER BY size, doc_id NULLS FIRST) - 1) AS pos FROM d JOIN e USING (ns, s))
SELECT doc_id, size, z AS source_size, target, (pos + e) // 1073741824 - pos // 1073741824 AS copies, size * ((pos + e) // 1073741824 - pos // 1073741824) AS taken FROM g"""

_OP13 = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v, CAST(sum(ln) AS BIGINT) AS total FROM k GROUP BY 1),
s AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
m AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (coalesce(m.total, 0) + v.v) AS p, 1 + 1000000000 * (ln + 1) // (v.total + v.v) AS q
  FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term LEFT JOIN m ON m.lang = s.lang AND m.source = s.source),
x AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f) WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2, "op4_warc": _OP4, "op5_quality": _OP5, "op12_mixing": _OP12, "op13_divergence": _OP13}
