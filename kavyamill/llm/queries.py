"""The operators' queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavyamill.llm import byte_bpe, decontaminate, language_id, licenses, line_dedup, near_dedup, quality_classifier, quality_rules, spelling, substring_dedup, toxicity, url_filter, vector_codes
from kavyamill.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator on all pages with made redirects, as the tables hold none: chains of seven pages, each redirected to the
    page before it."""
    pages = table(spark, sf_dir, "pages")
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("target"))
    redirects = pages.where("page_id % 7 <> 0").join(before, "page_id").select("url", "target")
    return url_filter.judge(pages, redirects=redirects).select("page_id", "host", "path", "rule", "verdict", "alias_verdict")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.dedup(table(spark, sf_dir, "documents")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), shortest=1)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_toxicity, op4_near_dedup, op5_url_filter, url_aliases, op6_substring_dedup, op7_byte_bpe, op8_line_dedup, op9_quality_classifier, op10_decontaminate, op11_language_id, op12_vector_codes, op13_spelling_variants)}


def _op1_sql() -> str:
    """All windows of all documents against all templates of their length, by exact shingles."""
    rows = []
    for name, text in licenses.TEMPLATES.items():
        words = licenses.template_words(text)
        length, step = licenses.window_of(len(words))
        rows.append(f"('{name}', {length}, {step}, [{', '.join(repr(w) for w in words)}])")
    shingles = "list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 4], ' ')))"
    return f"""
        WITH t AS (SELECT license_id, length, step, {shingles.format("words")} AS held FROM (VALUES {", ".join(rows)}) AS v(license_id, length, step, words)),
        w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, c.length, unnest(range(0, len(w), c.step)) AS start, w FROM w, (SELECT DISTINCT length, step FROM t) c),
        p AS (SELECT doc_id, length, start, {shingles.format("part")} AS shingles FROM (SELECT doc_id, length, start, w[start + 1:start + length] AS part FROM s) WHERE len(part) >= 5),
        m AS (SELECT doc_id, license_id, start, len(list_intersect(shingles, held)) / len(held) AS share FROM p JOIN t USING (length))
        SELECT doc_id, license_id, max(share) AS containment, CAST(count(*) AS BIGINT) AS n_windows, CAST(min(start) AS BIGINT) AS first_word FROM m WHERE share >= 0.8 GROUP BY doc_id, license_id"""


def _rules_sql() -> tuple[str, str]:
    fits = []
    for rule in sorted(url_filter.RULES, key=lambda x: (-len(x), x)):
        host, slash, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}') THEN '{rule}'")
    return " ".join(fits), " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in url_filter.RULES.items())


def _op5_sql() -> str:
    """Rules by the longest that fits. The tables' html has no canonical link and no refresh, so no url has an alias."""
    fits, verdicts = _rules_sql()
    return f"""
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        r AS (SELECT *, CASE {fits} END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE 'allow' END AS verdict FROM r"""


def _aliases_sql() -> str:
    """Rules as above; aliases by reachability over the redirects in both directions."""
    fits, verdicts = _rules_sql()
    return f"""
        WITH RECURSIVE p AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(url, '^.*?://[^#]*?([?][^#]*)', 1, 's') AS query FROM pages),
        r AS (SELECT page_id, host, path, host || path || query AS key, CASE {fits} END AS rule FROM p),
        o AS (SELECT *, CASE rule {verdicts} END AS own FROM r),
        e AS (SELECT a.key AS x, b.key AS y FROM o a JOIN o b ON a.page_id = b.page_id + 1 WHERE a.page_id % 7 <> 0 AND a.key <> b.key),
        both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        reach AS (SELECT x, x AS y FROM both_ways UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x),
        fate AS (SELECT x AS key, min(own) AS alias_verdict FROM reach JOIN (SELECT DISTINCT key AS y, own FROM o) k USING (y) GROUP BY x)
        SELECT page_id, host, path, rule, coalesce(own, alias_verdict, 'allow') AS verdict, alias_verdict FROM o LEFT JOIN fate USING (key)"""


def _op13_sql() -> str:
    """The checksum byte by byte from its table, words by their deletions' texts, pairs compared letter by letter."""
    differing = "len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i]))"
    return f"""
        WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS held FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
        found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[{spelling.LETTERS}]+')) AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 5 GROUP BY doc_id, run),
        coded AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM counted),
        summed AS (SELECT run, n, xor(list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, held[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM coded, crc),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {spelling.DAMAGE} = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM summed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        k AS (SELECT DISTINCT word, n, left(word, i) || substring(word, i + 2) AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w) UNION ALL SELECT word, n, word FROM w),
        p AS (SELECT DISTINCT a.word, a.n, b.word AS form, b.n AS form_n FROM k a JOIN k b USING (k) WHERE a.word <> b.word AND (length(a.word) <> length(b.word) OR {differing} = 1)),
        f AS (SELECT word, form, form_n FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY form_n DESC, form) = 1 AND form_n >= 2 * n),
        up AS (SELECT word, form AS root, 1 AS depth FROM f UNION ALL SELECT up.word, f.form, depth + 1 FROM up JOIN f ON up.root = f.word),
        r AS (SELECT word, arg_max(root, depth) AS root FROM up GROUP BY word)
        SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM w LEFT JOIN f USING (word) LEFT JOIN r USING (word) LEFT JOIN (SELECT word, count(*) AS n_near FROM p GROUP BY word) USING (word)"""


ORACLES: dict[str, str] = {"op1_license_scan": _op1_sql(), "op5_url_filter": _op5_sql(), "url_aliases": _aliases_sql(), "op13_spelling_variants": _op13_sql()}
