"""One registered query per operator, applied with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrafold.llm import ann, bpe, decontaminate, hard_negatives, langid, licenses, pii, quality, secret_scan, simhash, spelling, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document: fixed patterns and what the network adds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan.scan(docs, secret_scan.train(docs))
    kinds = F.transform("secrets", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    base = F.filter("secrets", lambda x: x["kind"] != secret_scan.ADDED)
    return out.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("secrets")).alias("spans"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each fiftieth vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, by a model of the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, keep_text=False)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, by a model of the texts that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = public_tokenizers.path("byte_bpe_50k.tiktoken"),
            pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Tokens of each document and the text that they decode to."""
    encoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, pattern)
    out = bpe.decode(encoded, vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document, by DataFrame functions alone."""
    found = pii.with_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: ~x["kind"].isin(*pii.ADDED))
    kinds = F.transform("pii", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS if k not in pii.ADDED]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License families named in each document's paragraphs."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.scan(docs, licenses.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_paragraphs"), F.array_join(families, ",").alias("families"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings that start earlier."""
    out = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of each document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that each word of the documents is a spelling variant of."""
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each hundredth vector and its five positives, after labels of each seventh have moved on."""
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality rules say of each document, the cascade in the order of a sample's rejections per cost."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, quality.plan(docs, report=_REPORTED), _REPORTED, quality.BASE)
    return out.select("doc_id", *_REPORTED, (F.col("short") | F.col("repetition")).alias("base_failed"), "kept")


_REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

QUERIES = {
    "op1_secrets": op1_secrets, "op2_neighbours": op2_neighbours,
    "op3_toxicity": op3_toxicity, "op4_language": op4_language, "op5_bpe": op5_bpe, "op6_pii": op6_pii, "op7_licenses": op7_licenses,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_dedup": op9_suffix_dedup, "op10_simhash": op10_simhash, "op11_spelling": op11_spelling,
    "op12_hard_negatives": op12_hard_negatives, "op13_quality": op13_quality,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "(" + "|".join(rf"{c}[0-9]{{2}}(\x20?[A-Z0-9]){{{n - 4}}}" for c, n in pii.IBAN_LENGTHS.items()) + ")",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_CODES = "list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(m, 4), ''), lambda x: CASE WHEN x <= '9' THEN ord(x) - 48 ELSE ord(x) - 55 END)"
_PII_CHECKS = {
    "email": "true",
    "ip": r"list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || left(ltrim(x, '0'), 3) AS INT) <= 255))",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), "
            "lambda x, i: CASE WHEN i % 2 = 1 THEN ord(x) - 48 WHEN ord(x) - 48 > 4 THEN 2 * (ord(x) - 48) - 9 ELSE 2 * (ord(x) - 48) END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": f"NOT regexp_matches(right(g, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(h, 1), '[A-Za-z0-9]') AND "
            f"list_reduce(list_prepend(0, {_CODES}), lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
}


def _pii_sql() -> str:
    """Positions are sums of the lengths of matches and of the texts between them."""
    parts = [f"""SELECT doc_id, {n} AS k, '{kind}' AS kind, s, s + length(m) AS e FROM (
        SELECT doc_id, f[i] AS m, p[i] AS g, p[i + 1] AS h,
               CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS p FROM documents)))
        WHERE {_PII_CHECKS[kind]}""" for n, (kind, pattern) in enumerate(_PII.items())]
    text = "kind || ':' || s || ':' || e"
    base = "FILTER (k < 4)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PII if k not in pii.ADDED)
    zero = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PII if k not in pii.ADDED)
    return f"""
WITH spans AS ({" UNION ALL ".join(parts)}),
per AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY k, s) {base} AS base, string_agg({text}, ',' ORDER BY k, s) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN per USING (doc_id)"""


_BLANK = r"\x20\x09-\x0D"


def _rejects(rule: quality.Rule) -> str:
    return f"{' + '.join(f'{w} * {f}' for f, w in rule.weights)} > {rule.above}"


_QUALITY = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, regexp_extract_all(t, '[^{_BLANK}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS l FROM d),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1) GROUP BY 1),
tops AS (SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM p) GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
        len(list_filter(l, lambda x: regexp_matches(x, '^[{_BLANK}]*[-*•]'))) AS n_bullet_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[{_BLANK}]*$'))) AS n_ellipsis_lines, coalesce(tops.n, 0) AS n_top_word
      FROM p LEFT JOIN covered USING (r) LEFT JOIN tops USING (r))
SELECT doc_id, {", ".join(_REPORTED)}, {" OR ".join(map(_rejects, quality.BASE))} AS base_failed, NOT ({" OR ".join(map(_rejects, quality.RULES))}) AS kept FROM f"""

_NEGATIVES = """
WITH r AS (SELECT row_number() OVER () AS n, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n AS a, a.id AS anchor, r.n, r.id, r.label = a.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
      FROM r a JOIN r ON a.n <> r.n AND len(a.v) = len(r.v) WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.id) <= 10"""

ORACLES = {
    "op12_hard_negatives": _NEGATIVES,
    "op13_quality": _QUALITY,
    "op6_pii": _pii_sql(),
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM b),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
