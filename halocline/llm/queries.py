"""The registered queries of the operators and of the pipeline."""

from halocline.llm import bayes_join, cover_tree, fill_middle, html_template, license_rules, mixing, multiset_hash, prefix_free
from halocline.llm import quality_rules, stable_knn, target_resampling, toxicity, vector_packing
from halocline.llm.common import table

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def word_tokenizer():
    """Place of the public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_source_mix(spark, sf_dir):
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


@query
def op2_prefix_free(spark, sf_dir):
    return prefix_free.removal_digest(table(spark, sf_dir, "documents"))


@query
def op3_html_template(spark, sf_dir):
    return html_template.extract(table(spark, sf_dir, "pages"))


@query
def op4_bayes_join(spark, sf_dir):
    return bayes_join.link_counts(table(spark, sf_dir, "documents"))


@query
def op5_vector_packing(spark, sf_dir):
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_cover_tree(spark, sf_dir):
    return cover_tree.top_scores(table(spark, sf_dir, "embeddings"))


@query
def op8_quality_rules(spark, sf_dir):
    return quality_rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op7_cover_tree"] = """
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum([a[1] * a[2] FOR a IN [[q.w[i], c.w[i]] FOR i IN range(1, least(len(q.w), len(c.w)) + 1)]]) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op9_license_scan(spark, sf_dir):
    return license_rules.license_summary(table(spark, sf_dir, "documents"))


@query
def op10_multiset_hash(spark, sf_dir):
    return multiset_hash.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op11_stable_kdtree(spark, sf_dir):
    return stable_knn.nearest(table(spark, sf_dir, "embeddings"))


@query
def op12_target_resampling(spark, sf_dir):
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_target_resampling"] = r"""
WITH RECURSIVE crc_table(i, c, step) AS (
    SELECT i, i, 0 FROM range(256) AS r(i)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1 FROM crc_table WHERE step < 8
), crc AS (
    SELECT list(c ORDER BY i) AS t FROM crc_table WHERE step = 8
), doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), aim AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM benchmark
), said AS (
    SELECT r, unnest(words) AS word FROM doc
), vocabulary AS (
    SELECT word, xor(4294967295, list_reduce(
        list_prepend(4294967295, [CAST('0x' || substr(hex(encode(word)), 2 * k + 1, 2) AS BIGINT) FOR k IN range(octet_length(encode(word)))]),
        lambda x, b: xor(x >> 8, t[xor(x & 255, b) + 1]))) % 10000 AS bucket
    FROM (SELECT word FROM said UNION SELECT word FROM aim), crc
), raw AS (
    SELECT bucket, count(*) AS n FROM said JOIN vocabulary USING (word) GROUP BY bucket
), target AS (
    SELECT bucket, count(*) AS n FROM aim JOIN vocabulary USING (word) GROUP BY bucket
), gain AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(target.n, 0) + 1) * ((SELECT count(*) FROM said) + 10000) AS DOUBLE)
                        / CAST((coalesce(raw.n, 0) + 1) * ((SELECT count(*) FROM aim) + 10000) AS DOUBLE))) AS BIGINT) AS g
    FROM raw FULL JOIN target USING (bucket)
), weighed AS (
    SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS total
    FROM said JOIN vocabulary USING (word) JOIN gain USING (bucket) GROUP BY r
), scored AS (
    SELECT doc.r, doc_id, len(words) AS n_features,
           coalesce(total // n - CASE WHEN total < 0 AND total % n <> 0 THEN 1 ELSE 0 END, 0) AS weight,
           CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM doc LEFT JOIN weighed ON doc.r = weighed.r
), noised AS (
    SELECT r, doc_id, n_features, weight,
           weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM scored
), placed AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
           10 * count(*) OVER () // 100 AS drawn
    FROM noised WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN place <= drawn THEN place END AS BIGINT) AS rank
FROM noised LEFT JOIN placed USING (r)
"""


@query
def op13_fill_middle(spark, sf_dir):
    return fill_middle.digest(table(spark, sf_dir, "documents"))


ORACLES["op13_fill_middle"] = r"""
WITH doc AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), cut AS (
    SELECT doc_id, text, t, len(t) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h FROM doc
), parts AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
                THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(t[1:least(h[1] % (n + 1), h[2] % (n + 1))], '') AS a,
           array_to_string(t[least(h[1] % (n + 1), h[2] % (n + 1)) + 1:greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS b,
           array_to_string(t[greatest(h[1] % (n + 1), h[2] % (n + 1)) + 1:n], '') AS c
    FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
              ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
