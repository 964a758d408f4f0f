"""Queries of the scalar library: text, URL, hash, date, array, JSON and HTML functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import ids, text, urls
from siltstone.sources.tables import table

CLEAN = r"trim(regexp_replace({0}, '[ \t\n\r\f\v]+', ' ', 'g'))"
PARTS = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
TRACKING = r"'(?i)^(?:utm_[^=]*|" + "|".join(urls.TRACKERS) + r")(?:=.*)?$'"
#: CTE with the parts of crawl_cache.url, for the URL twins.
URLS = rf"""r AS (SELECT url, lower(regexp_extract(url, {PARTS}, 1)) AS s, lower(regexp_extract(url, {PARTS}, 2)) AS a0, regexp_extract(url, {PARTS}, 3) AS p,
        list_filter(string_split(regexp_extract(url, {PARTS}, 4), '&'), lambda q: q <> '' AND NOT regexp_matches(q, {TRACKING})) AS q FROM {{0}}),
    u AS (SELECT url, s, CASE WHEN s = 'http' AND a0 LIKE '%:80' THEN a0[:-4] WHEN s = 'https' AND a0 LIKE '%:443' THEN a0[:-5] ELSE a0 END AS a, p, q FROM r)"""


def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """X20, X21: canonical form and dedupe key of every source_url of the evidence, one row per distinct URL."""
    rows = table(spark, folder, "canonical_evidence", F.col("source_url").alias("url")).where(F.col("url").isNotNull()).distinct()
    return rows.select("url", urls.canonical(F.col("url")).alias("canonical"), urls.dedupe_key(F.col("url")).alias("dedupe_key"))


URL_CANONICAL = f"""WITH {URLS.format("(SELECT DISTINCT source_url AS url FROM canonical_evidence WHERE source_url IS NOT NULL)")}
    SELECT url, CASE WHEN s = '' THEN url ELSE s || '://' || a || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical,
           s || '://' || a || regexp_replace(p, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS dedupe_key FROM u"""


def url_domain_counts(spark: SparkSession, folder: str) -> DataFrame:
    """X22, S9: cached pages per site, with how many differ after canonicalization."""
    rows = table(spark, folder, "crawl_cache", "url").select(urls.host(F.col("url")).alias("site"), urls.canonical(F.col("url")).alias("c"))
    return rows.groupBy("site").agg(F.count("*").alias("pages"), F.count_distinct("c").alias("resources"))


URL_DOMAIN_COUNTS = f"""WITH {URLS.format("crawl_cache")}
    SELECT regexp_replace(regexp_replace(lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', ''), '^$', '') AS site, count(*) AS pages,
           count(DISTINCT CASE WHEN s = '' THEN url ELSE s || '://' || a || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END) AS resources FROM u GROUP BY 1"""


def text_clean(spark: SparkSession, folder: str) -> DataFrame:
    """X1, X11, X16: cleaned and truncated text of every document, and the first filled of title and text."""
    docs = table(spark, folder, "documents", "doc_id", "text", "title")
    body = text.clean(F.col("text"))
    first = text.first_filled(F.col("title"), body)
    return docs.select("doc_id", F.sha2(body, 256).alias("body_hash"), text.truncated(body, 320).alias("short"), F.sha2(first, 256).alias("first_hash"))


TEXT_CLEAN = f"""WITH c AS (SELECT doc_id, title, {CLEAN.format("text")} AS body FROM documents)
    SELECT doc_id, sha256(body) AS body_hash, CASE WHEN length(body) > 320 THEN rtrim(substring(body, 1, 319)) || '…' ELSE body END AS short,
           sha256(coalesce(nullif(trim(title), ''), nullif(trim(body), ''))) AS first_hash FROM c"""
STOP = ["the", "and", "for", "with", "that", "this", "from", "are", "was"]


def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    """X2: sizes of the five tokenizations of every document."""
    t = F.col("text")
    docs = table(spark, folder, "documents", "doc_id", "text").where(t.isNotNull())
    sizes = {"a": text.tokens_a(t), "b": text.tokens_b(t), "c": text.tokens_c(t, STOP), "d": text.tokens_c(t, []), "e": text.tokens_e(t)}
    return docs.select("doc_id", *[F.size(v).cast("bigint").alias(f"tokens_{k}") for k, v in sizes.items()])


TOKEN_STATS = f"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'))) AS tokens_a,
    len(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]+'), lambda t: length(t) > 2)) AS tokens_b,
    len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]{{2,}}')), lambda t: NOT list_contains({STOP}, t))) AS tokens_c,
    len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_-]{{2,}}'))) AS tokens_d,
    len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS tokens_e FROM documents WHERE text IS NOT NULL"""
PHRASES = ("audit trail", "settlement ledger", "packet loss", "cross-border", "reserve")


def keyword_hits(spark: SparkSession, folder: str) -> DataFrame:
    """X4, X5: whole-word occurrences of phrases over all documents: documents that hold one, and occurrences."""
    docs = table(spark, folder, "documents", "text").where(F.col("text").isNotNull()).select(text.padded(F.col("text")).alias("pad"))
    found = F.array(*[F.struct(F.lit(p).alias("phrase"), text.phrase_count(F.col("pad"), p.replace("-", " ")).alias("n")) for p in PHRASES])
    return docs.select(F.inline(found)).where(F.col("n") > 0).groupBy("phrase").agg(F.count("*").alias("docs"), F.sum("n").alias("hits"))


_HIT = "CAST((length(pad) - length(replace(pad, '{0}', ''))) / {1} AS BIGINT)"
KEYWORD_HITS = (
    "WITH d AS (SELECT ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '  ') || ' ' AS pad FROM documents WHERE text IS NOT NULL), h AS ("
    + " UNION ALL ".join(f"SELECT '{p}' AS phrase, {_HIT.format(n := ' ' + '  '.join(p.replace('-', ' ').split()) + ' ', len(n))} AS n FROM d" for p in PHRASES)
    + ") SELECT phrase, count(*) AS docs, CAST(sum(n) AS BIGINT) AS hits FROM h WHERE n > 0 GROUP BY phrase"
)


def text_structure(spark: SparkSession, folder: str) -> DataFrame:
    """X8, X9, X45: sentences, headings, list items, links and numbers of every document."""
    t = F.col("text")
    docs = table(spark, folder, "documents", "doc_id", "text").where(t.isNotNull())
    return docs.select(
        "doc_id",
        F.size(text.sentences(t)).cast("bigint").alias("sentences"),
        F.array_join(text.headings(t), "|").alias("headings"),
        F.size(text.bullets(t)).cast("bigint").alias("bullets"),
        F.array_join(text.links(t), " ").alias("links"),
        F.round(F.aggregate(text.numbers(t), F.lit(0.0), lambda a, x: a + x), 4).alias("number_sum"),
    )


TEXT_STRUCTURE = r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+\s+|\n+'), lambda s: trim(s) <> '')) AS sentences,
    array_to_string(regexp_extract_all(text, '(?m)^#{1,3} +([^\n]+)$', 1), '|') AS headings, len(regexp_extract_all(text, '(?m)^[-*] +([^\n]+)$', 1)) AS bullets,
    array_to_string(list_filter(regexp_extract_all(text, 'https?://[^\s)>"]+'), lambda x, i: list_position(regexp_extract_all(text, 'https?://[^\s)>"]+'), x) = i), ' ') AS links,
    round(coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE))), 0.0), 4) AS number_sum
    FROM documents WHERE text IS NOT NULL"""


def md_sections(spark: SparkSession, folder: str) -> DataFrame:
    """S1, S2: level-2 sections of Markdown documents, in order, each with its body's hash."""
    docs = table(spark, folder, "documents", "doc_id", "text").where(F.col("text").rlike(r"(?m)^## "))
    pieces = docs.select("doc_id", F.posexplode(F.split(F.concat(F.lit("\n"), F.replace("text", F.lit("\r"), F.lit(""))), r"\n## +")).alias("pos", "piece")).where("pos > 0")
    head = F.trim(F.regexp_extract("piece", r"^([^\n]*)", 1))
    body = F.trim(F.regexp_replace(F.regexp_replace("piece", r"^[^\n]*\n?", ""), r"[ \n\t]+", " "))
    return pieces.select("doc_id", F.col("pos").cast("bigint").alias("pos"), head.alias("section"), F.sha2(body, 256).alias("body_hash"))


MD_SECTIONS = r"""WITH d AS (SELECT doc_id, regexp_split_to_array(chr(10) || replace(text, chr(13), ''), '\n## +') AS ps FROM documents WHERE regexp_matches(text, '(?m)^## ')),
    p AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS piece FROM d)
    SELECT doc_id, pos, trim(regexp_extract(piece, '^([^\n]*)', 1)) AS section, sha256(trim(regexp_replace(regexp_replace(piece, '^[^\n]*\n?', ''), '[ \n\t]+', ' ', 'g'))) AS body_hash FROM p WHERE pos > 0"""


def md_bullet_map(spark: SparkSession, folder: str) -> DataFrame:
    """S3: `- key: value` lines of Markdown documents as a map, the last value of a key winning; one row per entry."""
    t = F.replace("text", F.lit("\r"), F.lit(""))
    pattern = F.lit(r"(?m)^- ([a-z_]+): ([^\n]*)$")
    docs = table(spark, folder, "documents", "doc_id", "text").where(F.col("text").isNotNull())
    pairs = docs.select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all(t, pattern, 1).alias("k"), F.regexp_extract_all(t, pattern, 2).alias("v"))).alias("pos", "e"))
    rows = pairs.groupBy("doc_id", F.col("e.k").alias("key")).agg(F.max_by("e.v", "pos").alias("value"))
    return rows


MD_BULLET_MAP = r"""WITH d AS (SELECT doc_id, replace(text, chr(13), '') AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?m)^- ([a-z_]+): ([^\n]*)$', 1)) AS key, unnest(regexp_extract_all(t, '(?m)^- ([a-z_]+): ([^\n]*)$', 2)) AS value,
           unnest(range(len(regexp_extract_all(t, '(?m)^- ([a-z_]+): ([^\n]*)$', 1)))) AS pos FROM d)
    SELECT doc_id, key, max_by(value, pos) AS value FROM p GROUP BY doc_id, key"""


def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """S4, X52, X53: fields of the provenance JSON, counted per collector and attempt; broken JSON counts as null."""
    rows = table(spark, folder, "canonical_evidence", "provenance").select(F.get_json_object("provenance", "$.collector").alias("collector"), F.get_json_object("provenance", "$.attempt").cast("bigint").alias("attempt"))
    return rows.groupBy("collector", "attempt").agg(F.count("*").alias("n"))


JSON_FIELDS = """SELECT json_extract_string(TRY_CAST(provenance AS JSON), '$.collector') AS collector, TRY_CAST(json_extract_string(TRY_CAST(provenance AS JSON), '$.attempt') AS BIGINT) AS attempt, count(*) AS n
    FROM canonical_evidence GROUP BY 1, 2"""


def hash_ids(spark: SparkSession, folder: str) -> DataFrame:
    """X23, D9, E7: content-addressed ids of evidence, claim and record."""
    e = table(spark, folder, "canonical_evidence", "evidence_id", "source_url", "title", "problem", "layer").distinct()
    c = F.col
    return e.select(
        "evidence_id", "layer", ids.short_id(c("source_url"), c("title"), c("problem")).alias("content_id"), ids.short_id(text.clean(F.lower("problem"))).alias("claim_id"),
        ids.record_id(c("source_url"), c("layer")).alias("record_key"), F.coalesce(F.concat(F.lit("url:"), c("source_url")), F.concat(F.lit("hash:"), ids.short_id(c("title")))).alias("identity"),
    )  # fmt: skip


HASH_IDS = rf"""SELECT evidence_id, layer, substring(sha256(concat_ws('|', coalesce(source_url, ''), coalesce(title, ''), coalesce(problem, ''))), 1, 16) AS content_id,
    substring(sha256(coalesce({CLEAN.format("lower(problem)")}, '')), 1, 16) AS claim_id, substring(sha1(concat_ws('|', coalesce(source_url, ''), coalesce(layer, ''))), 1, 16) AS record_key,
    coalesce('url:' || source_url, 'hash:' || substring(sha256(coalesce(title, '')), 1, 16)) AS identity
    FROM (SELECT DISTINCT evidence_id, source_url, title, problem, layer FROM canonical_evidence)"""
AS_OF = "2026-01-01 00:00:00"


def date_parts(spark: SparkSession, folder: str) -> DataFrame:
    """X30, X32, X33: parsed stamp, month bucket, age and recency points of every evidence row, at a fixed as_of."""
    e = table(spark, folder, "canonical_evidence", "evidence_id", "retrieved_at", "published_at").distinct()
    parsed = F.coalesce(F.try_to_timestamp("published_at"), F.try_to_timestamp("retrieved_at"))
    days = F.datediff(F.to_date(F.lit(AS_OF)), parsed.cast("date"))
    points = F.when(days.isNull(), 0).when(days <= 30, 10).when(days <= 180, 7).when(days <= 365, 4).otherwise(0)
    return e.select("evidence_id", "retrieved_at", "published_at", F.date_format(parsed, "yyyy-MM").alias("month"), days.cast("bigint").alias("age_days"), points.cast("bigint").alias("recency"))


DATE_PARTS = f"""WITH e AS (SELECT DISTINCT evidence_id, retrieved_at, published_at, coalesce(TRY_CAST(published_at AS TIMESTAMPTZ), TRY_CAST(retrieved_at AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS ts FROM canonical_evidence),
    d AS (SELECT *, date_diff('day', CAST(ts AS DATE), DATE '{AS_OF[:10]}') AS age FROM e)
    SELECT evidence_id, retrieved_at, published_at, strftime(ts, '%Y-%m') AS month, age AS age_days,
           CAST(CASE WHEN age IS NULL THEN 0 WHEN age <= 30 THEN 10 WHEN age <= 180 THEN 7 WHEN age <= 365 THEN 4 ELSE 0 END AS BIGINT) AS recency FROM d"""


def html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """X55–X58, F20: title, links, blocks and stripped text of every cached page, and whether it reads like an error page."""
    h = F.col("html")
    pages = table(spark, folder, "crawl_cache", "url", "html").where(h.isNotNull())
    body = F.regexp_replace(h, r"(?is)<(?:script|style|svg)\b.*?</(?:script|style|svg)>", " ")
    plain = text.clean(F.regexp_replace(body, "<[^>]+>", " "))
    return pages.select(
        "url",
        F.trim(F.regexp_extract(h, r"(?is)<title>([^<]*)</title>", 1)).alias("page_title"),
        F.size(F.regexp_extract_all(h, F.lit(r'(?i)<a [^>]*href="([^"]*)"'), 1)).cast("bigint").alias("links"),
        F.size(F.regexp_extract_all(h, F.lit(r"(?i)<(h[1-3]|p|li)\b"), 1)).cast("bigint").alias("blocks"),
        F.sha2(plain, 256).alias("text_hash"),
        (F.length(plain) < 400).__and__(F.lower(plain).rlike("not found|404|forbidden|access denied|unavailable|enable javascript")).alias("soft_error"),
    )


HTML_EXTRACT = r"""WITH p AS (SELECT url, html, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|svg)\b.*?</(?:script|style|svg)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS plain
               FROM crawl_cache WHERE html IS NOT NULL)
    SELECT url, trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)) AS page_title, len(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1)) AS links,
           len(regexp_extract_all(html, '(?i)<(h[1-3]|p|li)\b', 1)) AS blocks, sha256(plain) AS text_hash,
           length(plain) < 400 AND regexp_matches(lower(plain), 'not found|404|forbidden|access denied|unavailable|enable javascript') AS soft_error FROM p"""
def names_and_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """X7, X15, X49, X54: of every company its slug, title and name from its URL, cleaned keywords and the hash of its content."""
    c = table(spark, folder, "company_data", "id", "company_name", "url", "keywords", "problem")
    words = text.sanitized(F.split("keywords", r"[;,|\n]"))
    content = text.canonical_json(problem=F.col("problem"), company_name=F.col("company_name"))
    return c.select(
        "id", text.slug(F.col("company_name")).alias("slug"), text.title_from_url(F.col("url"), F.lit("Untitled")).alias("title"), text.name_from_url(F.col("url"), F.lit("Unknown")).alias("name"),
        F.coalesce(F.array_join(words, "|"), F.lit("")).alias("words"), F.sha2(content, 256).alias("content_hash"),
    )  # fmt: skip


_CAPITALS = "array_to_string(list_transform(string_split(trim(regexp_replace({}, '[-_]+', ' ', 'g')), ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ')"
NAMES_AND_HASHES = rf"""WITH c AS (SELECT id, company_name, problem, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '/')[-1] AS tail,
      list_filter(list_transform(regexp_split_to_array(keywords, '[;,|
]'), lambda x: trim(regexp_replace(x, '[ 	
]+', ' ', 'g'))), lambda x: x <> '') AS w FROM company_data)
    SELECT id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(company_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug,
      coalesce(nullif({_CAPITALS.format("coalesce(nullif(tail, ''), nullif(host, ''))")}, ''), 'Untitled') AS title, coalesce(nullif({_CAPITALS.format("string_split(replace(string_split(host, ':')[1], 'www.', ''), '.')[1]")}, ''), 'Unknown') AS name,
      coalesce(array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i)[1:6], '|'), '') AS words,
      sha256(CAST(json_object('company_name', coalesce(company_name, ''), 'problem', coalesce(problem, '')) AS VARCHAR)) AS content_hash FROM c"""


QUERIES = {
    "names_and_hashes": (names_and_hashes, NAMES_AND_HASHES),
    "url_canonical": (url_canonical, URL_CANONICAL), "url_domain_counts": (url_domain_counts, URL_DOMAIN_COUNTS), "text_clean": (text_clean, TEXT_CLEAN), "token_stats": (token_stats, TOKEN_STATS),
    "keyword_hits": (keyword_hits, KEYWORD_HITS), "text_structure": (text_structure, TEXT_STRUCTURE), "md_sections": (md_sections, MD_SECTIONS), "md_bullet_map": (md_bullet_map, MD_BULLET_MAP),
    "json_fields": (json_fields, JSON_FIELDS), "hash_ids": (hash_ids, HASH_IDS), "date_parts": (date_parts, DATE_PARTS), "html_extract": (html_extract, HTML_EXTRACT),
}  # fmt: skip
