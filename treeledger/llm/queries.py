"""The operators of this package over their whole tables, with SQL counterparts where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm import (decontamination, importance, jaccard_join, language, licenses, packing, page_text, repetition, secret_scan,
                            simhash, source_divergence, token_counts, url_rules)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def packing_sql(max_length: int = packing.MAX_LENGTH, buckets: int = packing.BUCKETS,
                budget: int = packing.BUDGET) -> str:
    """The dynamic program with one table per number of buckets: d{k}(j, cost, bounds)."""
    pad = "t.length * (t.n - {n}) - (t.w - {w})"
    steps = [f"d1 AS (SELECT t.j, {pad.format(n=0, w=0)} AS cost, [t.length] AS bounds FROM h t)"]
    for k in range(2, buckets + 1):
        steps.append(f"""d{k} AS (SELECT j, min(cost) AS cost, arg_min(bounds, struct_pack(cost := cost, i := i)) AS bounds
            FROM (SELECT t.j, f.j AS i, f.cost + {pad.format(n='f.n', w='f.w')} AS cost, list_append(f.bounds, t.length) AS bounds
                  FROM (SELECT * FROM d{k - 1} JOIN h USING (j)) f JOIN h t ON t.j > f.j) GROUP BY j)""")
    chosen = " UNION ALL ".join(
        f"SELECT bounds FROM d{k}, top WHERE d{k}.j = top.j AND {k} = least(top.j, {buckets})" for k in range(1, buckets + 1))
    return rf"""
        WITH counted AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents),
        pieces AS (SELECT doc_id, piece, n, piece * {max_length} AS start, least({max_length}, n - piece * {max_length}) AS n_tokens
            FROM (SELECT doc_id, n, unnest(range(0, greatest((n + {max_length} - 1) // {max_length}, 1))) AS piece FROM counted)),
        h AS MATERIALIZED (SELECT length, CAST(row_number() OVER (ORDER BY length) AS BIGINT) AS j,
                CAST(sum(c) OVER (ORDER BY length) AS BIGINT) AS n, CAST(sum(c * length) OVER (ORDER BY length) AS BIGINT) AS w
            FROM (SELECT n_tokens AS length, count(*) AS c FROM pieces WHERE n_tokens > 0 GROUP BY 1)),
        {', '.join(steps)},
        top AS (SELECT max(j) AS j FROM h),
        chosen AS ({chosen}),
        uppers AS (SELECT unnest(bounds) AS bucket_length, unnest(range(len(bounds))) AS bucket FROM chosen),
        limits AS (SELECT bucket, bucket_length, lag(bucket_length, 1, 0) OVER (ORDER BY bucket) AS low,
                {budget} // bucket_length AS capacity FROM uppers),
        ranked AS (SELECT doc_id, piece, start, n_tokens, bucket, bucket_length, capacity,
                row_number() OVER (PARTITION BY bucket ORDER BY doc_id, piece) - 1 AS r
            FROM pieces JOIN limits ON n_tokens > low AND n_tokens <= bucket_length),
        offsets AS (SELECT bucket, coalesce(sum(batches) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (SELECT bucket, max(r // capacity) + 1 AS batches FROM ranked GROUP BY bucket))
        SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST(start AS BIGINT) AS start, CAST(n_tokens AS BIGINT) AS n_tokens,
            CAST(bucket AS BIGINT) AS bucket, CAST(bucket_length AS BIGINT) AS bucket_length,
            CAST(before + r // capacity AS BIGINT) AS batch, CAST(r % capacity AS BIGINT) AS slot
        FROM ranked JOIN offsets USING (bucket)
        UNION ALL SELECT doc_id, piece, start, n_tokens, NULL, NULL, NULL, NULL FROM pieces WHERE n_tokens = 0"""


@query("op1_packing", packing_sql())
def packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf, "documents"))


@query("op2_secrets")
def secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf, "documents"), keep=["doc_id"])


def quality_sql(length: int = 10, share: float = 0.3, longest: int = 300) -> str:
    """A word lies in a repeat of `length` words or more if it lies in a window of that many that occurs twice."""
    def windows(name: str, n: int, key: str) -> str:
        return f"""{name} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS times FROM (
            SELECT doc_id, i, {key} AS key FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM d))),
        {name}_places AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM {name}, range({n}) AS t(k)
            WHERE times > 1 GROUP BY doc_id)"""
    whole = "array_to_string(list_slice(words, i, i + {}), ' ')"
    return rf"""
        WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        {windows('short', 3, whole.format(2))},
        {windows('long', length, whole.format(length - 1))},
        huge AS (SELECT doc_id FROM (SELECT doc_id, hash(list_slice(words, i, i + {longest})) AS key
                FROM (SELECT doc_id, words, unnest(range(1, len(words) - {longest - 1})) AS i FROM d))
            GROUP BY doc_id, key HAVING count(*) > 1),
        facts AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(lines.n, 0) AS n_dup_lines, coalesce(short_places.n, 0) AS n_repeat_words,
                coalesce(long_places.n, 0) AS n_covered_words, doc_id IN (SELECT doc_id FROM huge) AS too_long
            FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN short_places USING (doc_id) LEFT JOIN long_places USING (doc_id))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
            CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
            n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_covered_words <= {share} * n_words
                AND NOT too_long AS kept FROM facts"""


@query("op4_quality", quality_sql())
def quality(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.judge(table(spark, sf, "documents"), keep=["doc_id"]).drop("longest_repeat")


BENCHMARK_SQL = rf"""
    WITH plain AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
    worded AS MATERIALIZED (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM plain),
    items AS (SELECT id AS item, list_slice(words, i, i + {decontamination.WINDOW - 1}) AS w FROM (
        SELECT id, words, unnest(range(1, greatest(len(words) - {decontamination.WINDOW - 2}, 2))) AS i
        FROM worded WHERE side = 'b' AND len(words) > 0)),
    sizes AS (SELECT DISTINCT len(w) AS n FROM items),
    grams AS (SELECT id, i, n, list_slice(words, i, i + n - 1) AS w FROM (
        SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM worded, sizes WHERE side = 'd' AND len(words) >= n)),
    hits AS MATERIALIZED (SELECT id, i, n, item FROM grams JOIN items USING (w)),
    places AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY id),
    found AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS names
        FROM hits GROUP BY id)
    SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM worded LEFT JOIN places USING (id) LEFT JOIN found USING (id) WHERE side = 'd'"""


@query("op6_decontaminate", BENCHMARK_SQL)
def contaminated(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    return decontamination.digest(found)


@query("op7_simhash")
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op5_tokens")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.count_tokens(table(spark, sf, "documents"), vocabulary, keep=["doc_id"])


@query("op8_licenses")
def license_notices(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf, "documents"), keep=["doc_id"]))


@query("op9_language")
def languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language.identify(docs, language.fit(docs), keep=["doc_id"])
    held_out = F.coalesce(language.remainder("doc_id") == 2, F.lit(False))
    return found.withColumn("held_out", held_out)


@query("op10_page_text")
def main_text(spark: SparkSession, sf: str) -> DataFrame:
    return page_text.extract(table(spark, sf, "pages"))


URL_SQL = r"""
    WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    rules(verdict, h, p, listed) AS (VALUES {rules}),
    fits AS (SELECT page_id, host, path, verdict, h || p AS rule, listed, row_number() OVER (
            PARTITION BY page_id, listed ORDER BY length(h || p) DESC, verdict = 'block' DESC, h || p DESC) AS place
        FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
    SELECT page_id, coalesce(parts.host, '') AS host, coalesce(parts.path, '') AS path, own.rule AS rule,
        coalesce(own.verdict, other.verdict, 'allow') AS verdict, other.rule AS default_rule
    FROM parts LEFT JOIN (SELECT * FROM fits WHERE listed AND place = 1) own USING (page_id)
        LEFT JOIN (SELECT * FROM fits WHERE NOT listed AND place = 1) other USING (page_id)"""
# What decides where no rule fits; given by the query, as the operator has none of its own.
URL_DEFAULTS = (("block", "ads-track.example.org", ""), ("block", "spam-farm.example.org", ""))
URL_RULES = ", ".join(f"('{v}', '{h}', '{p}', {listed})" for rules, listed in ((url_rules.RULES, True), (URL_DEFAULTS, False))
                      for v, h, p in rules)


@query("op3_urls", URL_SQL.format(rules=URL_RULES))
def url_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge(table(spark, sf, "pages"), url_rules.rule_table(spark, defaults=URL_DEFAULTS))


JACCARD_SQL = rf"""
    WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    shingled AS MATERIALIZED (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
            range(1, greatest(len(words) - {jaccard_join.SHINGLE - 2}, 2)),
            lambda i: array_to_string(list_slice(words, i, i + {jaccard_join.SHINGLE - 1}), ' ')))) END AS s FROM worded),
    sets AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS rep FROM shingled WHERE len(s) > 0 GROUP BY s),
    items AS MATERIALIZED (SELECT rep, n, unnest(s) AS w FROM sets),
    links AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.w = b.w AND a.rep <> b.rep
            AND 100 * a.n >= {jaccard_join.PERCENT} * b.n AND 100 * b.n >= {jaccard_join.PERCENT} * a.n
        GROUP BY a.rep, b.rep, a.n, b.n
        HAVING {100 + jaccard_join.PERCENT} * count(*) >= {jaccard_join.PERCENT} * (a.n + b.n)),
    reach AS (SELECT rep AS root, rep AS node FROM sets
        UNION SELECT reach.root, links.b FROM reach JOIN links ON links.a = reach.node),
    roots AS (SELECT node AS rep, min(root) AS component_id FROM reach GROUP BY node)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM shingled LEFT JOIN sets USING (s) LEFT JOIN roots USING (rep)"""


@query("op11_jaccard", JACCARD_SQL)
def similar_shingles(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents"))


@query("op12_importance")
def resampled(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


DIVERGENCE_SQL = rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(
            coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
    terms AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (
        SELECT doc_id, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
    kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM terms GROUP BY ALL HAVING sum(docs) >= {source_divergence.LEAST_DOCUMENTS}),
    grid AS (SELECT g.lang, g.source, kept.term, coalesce(terms.n, 0) AS n, kept.n AS all_n
        FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept USING (lang) LEFT JOIN terms USING (lang, source, term)),
    priced AS MATERIALIZED (SELECT lang, source, term, n,
            1 + 1000000000 * (n + 2) // (sum(n) OVER w + 2 * count(*) OVER w) AS p,
            1 + 1000000000 * (all_n + 2) // (sum(all_n) OVER w + 2 * count(*) OVER w) AS q
        FROM grid WINDOW w AS (PARTITION BY lang, source)),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM d),
    parts AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
            FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
            LEFT JOIN apart ON apart.lang = g.lang AND apart.source = g.source AND apart.item = o.source
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM priced WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
    WHERE part = 'pair' OR rank <= {source_divergence.TOP_TERMS}"""


@query("op13_divergence", DIVERGENCE_SQL)
def divergent_sources(spark: SparkSession, sf: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf, "documents"))
