"""Queries of key merges, joins, set operations and data contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import areas, urls
from siltstone.operators import merging
from siltstone.sources.tables import table

HOST = r"""nullif(regexp_replace(lower(regexp_extract({0}, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '')"""
STAMP = "coalesce(TRY_CAST({0} AS TIMESTAMPTZ), TIMESTAMPTZ '9999-12-31 00:00:00+00')"


def evidence(spark: SparkSession, folder: str, *columns) -> DataFrame:
    """Columns of the evidence table."""
    return table(spark, folder, "canonical_evidence", *columns)


def observation_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated deliveries of one evidence_id folded into one row."""
    rows = evidence(spark, folder, "evidence_id", "updated_at", "title", "source_url", "problem", "content_hash", "run_id")
    out = merging.observations(rows, "evidence_id", "updated_at", ["title", "source_url"], ["problem", "content_hash"], ["run_id"])
    return out.withColumn("run_id_variants", F.array_join("run_id_variants", ","))


_TIE = "struct_pack(a := content_hash, b := problem, c := source_url, d := title)"
OBSERVATION_MERGE = f"""WITH e AS (SELECT *, {STAMP.format("updated_at")} AS ts FROM canonical_evidence),
    r AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY ts, content_hash NULLS FIRST, problem NULLS FIRST, source_url NULLS FIRST, title NULLS FIRST) AS f,
                 row_number() OVER (PARTITION BY evidence_id ORDER BY ts DESC, content_hash DESC NULLS LAST, problem DESC NULLS LAST, source_url DESC NULLS LAST, title DESC NULLS LAST) AS l FROM e)
    SELECT evidence_id, count(*) AS observation_count, min(updated_at) AS first_seen, max(updated_at) AS last_seen, max(CASE WHEN f = 1 THEN title END) AS first_title,
           max(CASE WHEN f = 1 THEN source_url END) AS first_source_url, max(CASE WHEN l = 1 THEN problem END) AS latest_problem, max(CASE WHEN l = 1 THEN content_hash END) AS latest_content_hash,
           array_to_string(list_sort(list_distinct(list(run_id))), ',') AS run_id_variants FROM r GROUP BY evidence_id"""
_ONE = ("evidence_id", "updated_at", "content_hash", "confidence")


def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """Latest row of each evidence_id by updated_at; rows without a stamp come first."""
    return merging.latest(evidence(spark, folder, *_ONE), ["evidence_id"], F.coalesce("updated_at", F.lit("")))


LATEST_PER_KEY = """SELECT evidence_id, updated_at, content_hash, confidence FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY coalesce(updated_at, '') DESC,
    updated_at DESC NULLS LAST, content_hash DESC NULLS LAST, confidence DESC NULLS LAST) AS n FROM canonical_evidence) WHERE n = 1"""


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """K4, K6: the rows without updated_at as a stored table, upserted with the rows that have one."""
    rows = evidence(spark, folder, *_ONE)
    old = merging.earliest(rows.where(F.col("updated_at").isNull()), ["evidence_id"], F.col("content_hash"))
    return merging.upsert(old, rows.where(F.col("updated_at").isNotNull()), ["evidence_id"], F.col("updated_at"))


UPSERT_LATEST = """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY content_hash, updated_at, confidence) AS n FROM canonical_evidence WHERE updated_at IS NULL) WHERE n = 1),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY updated_at DESC, content_hash DESC, confidence DESC) AS n FROM canonical_evidence WHERE updated_at IS NOT NULL) WHERE n = 1)
    SELECT evidence_id, updated_at, content_hash, confidence FROM w UNION ALL SELECT evidence_id, updated_at, content_hash, confidence FROM o WHERE evidence_id NOT IN (SELECT evidence_id FROM w)"""


def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """K5: links (evidence, claim) of the Lab layer as a stored table, other layers' links added where the evidence has none."""
    links = evidence(spark, folder, "evidence_id", "layer", F.substring(F.sha2("problem", 256), 1, 16).alias("claim_id")).where(F.col("claim_id").isNotNull()).distinct()
    lab = merging.earliest(links.where("layer = 'Lab'"), ["evidence_id"], F.col("claim_id"))
    return merging.insert_ignore(lab, links.where("layer <> 'Lab'"), ["evidence_id"], F.col("layer"), F.col("claim_id"))


INSERT_IGNORE = """WITH k AS (SELECT DISTINCT evidence_id, layer, substring(sha256(problem), 1, 16) AS claim_id FROM canonical_evidence WHERE problem IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY layer <> 'Lab', CASE WHEN layer <> 'Lab' THEN layer END, claim_id) AS n FROM k WHERE layer IS NOT NULL)
    SELECT evidence_id, layer, claim_id FROM r WHERE n = 1"""


def independence_group(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the first source of its content, by a minimum per content instead of a window."""
    rows = evidence(spark, folder, "evidence_id", "source_id", "content_hash", "retrieved_at").distinct()
    first = rows.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min(F.struct(merging.stamp(F.col("retrieved_at")).alias("t"), "source_id")).alias("f"))
    joined = rows.join(first, "content_hash", "left")
    return joined.select("evidence_id", "source_id", F.coalesce("f.source_id", "source_id").alias("group_source")).distinct()


INDEPENDENCE_GROUP = f"""WITH e AS (SELECT DISTINCT evidence_id, source_id, content_hash, retrieved_at FROM canonical_evidence)
    SELECT DISTINCT evidence_id, source_id, CASE WHEN content_hash IS NULL THEN source_id ELSE coalesce(first_value(source_id) OVER (PARTITION BY content_hash
        ORDER BY {STAMP.format("retrieved_at")}, source_id NULLS FIRST), source_id) END AS group_source FROM e"""


def registry_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Sites of the crawl cache as registry, sites of the evidence as configuration."""
    known = table(spark, folder, "crawl_cache", urls.host(F.col("final_url")).alias("site"), "status_code").where(F.col("site").isNotNull())
    known = known.groupBy("site").agg(F.when(F.max("status_code") < 400, "active").otherwise("failing").alias("status"))
    wanted = evidence(spark, folder, urls.host(F.col("source_url")).alias("site")).where(F.col("site").isNotNull()).distinct()
    return merging.sync(known, wanted, "site")


REGISTRY_SYNC = f"""WITH k AS (SELECT {HOST.format("final_url")} AS site, CASE WHEN max(status_code) < 400 THEN 'active' ELSE 'failing' END AS status FROM crawl_cache GROUP BY 1 HAVING site IS NOT NULL),
    w AS (SELECT DISTINCT {HOST.format("source_url")} AS site FROM canonical_evidence)
    SELECT coalesce(k.site, w.site) AS site, k.status AS old, CASE WHEN w.site IS NULL THEN 'deprecate' WHEN k.site IS NULL THEN 'insert' ELSE 'update' END AS action
    FROM k FULL OUTER JOIN (SELECT * FROM w WHERE site IS NOT NULL) w ON k.site = w.site"""


def discovery_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the evidence that the crawl cache lacks, by site, with support and discovery score."""
    rows = evidence(spark, folder, urls.canonical(F.col("source_url")).alias("c"), urls.host(F.col("source_url")).alias("site"), "layer", areas.area(F.col("research_area")).alias("area"))
    cached = table(spark, folder, "crawl_cache", urls.canonical(F.col("url")).alias("c")).distinct()
    found = rows.where(F.col("site").isNotNull()).join(cached, "c", "left_anti").groupBy("site")
    out = found.agg(F.count("*").alias("support"), F.count_distinct("layer").alias("layers"), F.count_distinct("area").alias("areas"))
    score = F.lit(0.35) + 0.1 * F.least("support", F.lit(5)) + 0.08 * F.least("layers", F.lit(3)) + 0.05 * F.least("areas", F.lit(3))
    return out.withColumn("score", F.round(F.least(F.lit(1.0), score), 4))


def _canonical_sql(column: str) -> str:
    from siltstone.plans.scalars import PARTS, TRACKING

    part = lambda i: f"regexp_extract({column}, {PARTS}, {i})"
    s, a, q = f"lower({part(1)})", f"lower({part(2)})", f"list_filter(string_split({part(4)}, '&'), lambda q: q <> '' AND NOT regexp_matches(q, {TRACKING}))"
    bare = f"CASE WHEN {s} = 'http' AND {a} LIKE '%:80' THEN ({a})[:-4] WHEN {s} = 'https' AND {a} LIKE '%:443' THEN ({a})[:-5] ELSE {a} END"
    return f"CASE WHEN {s} = '' THEN {column} ELSE {s} || '://' || {bare} || CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END || CASE WHEN len({q}) > 0 THEN '?' || array_to_string({q}, '&') ELSE '' END END"


DISCOVERY_CANDIDATES = f"""WITH e AS (SELECT {_canonical_sql("source_url")} AS c, {HOST.format("source_url")} AS site, layer, {areas.AREA_SQL} AS area FROM canonical_evidence),
    g AS (SELECT site, count(*) AS support, count(DISTINCT layer) AS layers, count(DISTINCT area) AS areas FROM e
          WHERE site IS NOT NULL AND c NOT IN (SELECT {_canonical_sql("url")} FROM crawl_cache WHERE url IS NOT NULL) GROUP BY site)
    SELECT *, round(least(1.0, 0.35 + 0.1 * least(support, 5) + 0.08 * least(layers, 3) + 0.05 * least(areas, 3)), 4) AS score FROM g"""


def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each evidence URL looked up in the crawl cache by canonical URL, else by site: hit, site or miss."""
    asked = evidence(spark, folder, "source_url").where(F.col("source_url").isNotNull()).distinct().select("source_url", urls.canonical(F.col("source_url")).alias("c"), urls.host(F.col("source_url")).alias("site"))
    pages = table(spark, folder, "crawl_cache", "url", "status_code")
    exact = pages.select(urls.canonical(F.col("url")).alias("c"), "status_code").groupBy("c").agg(F.max("status_code").alias("exact"))
    site = pages.select(urls.host(F.col("url")).alias("site"), "status_code").groupBy("site").agg(F.max("status_code").alias("by_site"))
    out = asked.join(exact, "c", "left").join(site, "site", "left")
    how = F.when(F.col("exact").isNotNull(), "hit").when(F.col("by_site").isNotNull(), "site").otherwise("miss")
    return out.select("source_url", how.alias("found"), F.coalesce("exact", "by_site").alias("status_code"))


CACHE_LOOKUP = f"""WITH a AS (SELECT DISTINCT source_url, {_canonical_sql("source_url")} AS c, {HOST.format("source_url")} AS site FROM canonical_evidence WHERE source_url IS NOT NULL),
    x AS (SELECT {_canonical_sql("url")} AS c, max(status_code) AS exact FROM crawl_cache GROUP BY 1), s AS (SELECT {HOST.format("url")} AS site, max(status_code) AS by_site FROM crawl_cache GROUP BY 1)
    SELECT source_url, CASE WHEN exact IS NOT NULL THEN 'hit' WHEN by_site IS NOT NULL THEN 'site' ELSE 'miss' END AS found, coalesce(exact, by_site) AS status_code
    FROM a LEFT JOIN x USING (c) LEFT JOIN s USING (site)"""


def trust_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Mean trust of the sources of each funding call, 0.6 for those without one."""
    rows = evidence(spark, folder, "funding_call_id", "source_url", "source_quality").distinct()
    trust = table(spark, folder, "crawl_cache", "url", "status_code").groupBy("url").agg(F.when(F.min("status_code") < 400, F.lit(1.0)).otherwise(F.lit(0.2)).alias("trust"))
    joined = rows.join(trust, rows.source_url == trust.url, "left")
    return joined.groupBy("funding_call_id").agg(F.round(F.avg(F.coalesce("trust", F.lit(0.6))), 6).alias("trust"), F.round(F.avg("source_quality"), 6).alias("quality"))


TRUST_LOOKUP = """WITH r AS (SELECT DISTINCT funding_call_id, source_url, source_quality FROM canonical_evidence), t AS (SELECT url, CASE WHEN min(status_code) < 400 THEN 1.0 ELSE 0.2 END AS trust FROM crawl_cache GROUP BY url)
    SELECT funding_call_id, round(avg(coalesce(CAST(trust AS DOUBLE), 0.6)), 6) AS trust, round(avg(source_quality), 6) AS quality FROM r LEFT JOIN t ON r.source_url = t.url GROUP BY funding_call_id"""


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Full outer merge of experts' sites, hackathon sites and the registry, with the first known status."""
    side = lambda name: table(spark, folder, name, urls.host(F.col("url")).alias("site")).where(F.col("site").isNotNull()).groupBy("site").agg(F.count("*").alias(f"n_{name.split('_')[0]}"))
    zones = table(spark, folder, "site_zones", "site", "zone")
    out = side("expert_data").join(side("hackathon_data"), "site", "full_outer").join(zones, "site", "full_outer")
    status = F.when(F.col("zone").isNull(), "new").when(F.col("n_expert").isNull() & F.col("n_hackathon").isNull(), "idle").otherwise("known")
    return out.select("site", F.coalesce("n_expert", F.lit(0)).alias("experts"), F.coalesce("n_hackathon", F.lit(0)).alias("hackathons"), status.alias("status"))


REVIEW_QUEUE = f"""WITH e AS (SELECT {HOST.format("url")} AS site, count(*) AS n FROM expert_data GROUP BY 1), h AS (SELECT {HOST.format("url")} AS site, count(*) AS n FROM hackathon_data GROUP BY 1),
    eh AS (SELECT coalesce(e.site, h.site) AS site, e.n AS ne, h.n AS nh FROM (SELECT * FROM e WHERE site IS NOT NULL) e FULL OUTER JOIN (SELECT * FROM h WHERE site IS NOT NULL) h ON e.site = h.site)
    SELECT coalesce(eh.site, z.site) AS site, coalesce(ne, 0) AS experts, coalesce(nh, 0) AS hackathons,
           CASE WHEN zone IS NULL THEN 'new' WHEN ne IS NULL AND nh IS NULL THEN 'idle' ELSE 'known' END AS status FROM eh FULL OUTER JOIN site_zones z ON eh.site = z.site"""


def attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Records attributed to funding calls: an explicit call suppresses the fallback by area of the record."""
    rows = evidence(spark, folder, "evidence_id", "funding_call_id", areas.area(F.col("research_area")).alias("area")).distinct()
    calls = table(spark, folder, "funding_data", "call_id", areas.area(F.col("focus_area")).alias("area")).where(F.col("call_id").isNotNull())
    named = rows.join(calls.select("call_id").distinct(), rows.funding_call_id == F.col("call_id"), "left_semi")
    explicit = named.select("evidence_id", F.col("funding_call_id").alias("attributed"), F.lit("explicit").alias("how"))
    per_area = calls.groupBy("area").agg(F.min("call_id").alias("attributed"))
    rest = rows.join(named.select("evidence_id").distinct(), "evidence_id", "left_anti").join(per_area, "area")
    return explicit.unionByName(rest.select("evidence_id", "attributed", F.lit("area").alias("how"))).distinct()


ATTRIBUTION = f"""WITH r AS (SELECT DISTINCT evidence_id, funding_call_id, {areas.AREA_SQL} AS area FROM canonical_evidence),
    c AS (SELECT call_id, {areas.AREA_SQL.replace("research_area", "focus_area")} AS area FROM funding_data WHERE call_id IS NOT NULL),
    x AS (SELECT evidence_id, funding_call_id AS attributed, 'explicit' AS how FROM r WHERE funding_call_id IN (SELECT call_id FROM c)), a AS (SELECT area, min(call_id) AS attributed FROM c GROUP BY area)
    SELECT DISTINCT * FROM x UNION SELECT evidence_id, attributed, 'area' AS how FROM r JOIN a ON r.area = a.area WHERE evidence_id NOT IN (SELECT evidence_id FROM x)"""


def contract_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Members that one of two sets of layers, areas or call ids has and the other lacks, both ways."""
    e = evidence(spark, folder, "layer", areas.area(F.col("research_area")).alias("area"), "funding_call_id")
    d = table(spark, folder, "documents", "layer", areas.area(F.col("research_area")).alias("area"))
    f = table(spark, folder, "funding_data", "call_id")
    left = e.select(F.lit("layer").alias("kind"), F.col("layer").alias("member")).union(e.select(F.lit("area"), "area")).union(e.where("funding_call_id <> ''").select(F.lit("call"), "funding_call_id"))
    right = d.select(F.lit("layer").alias("kind"), F.col("layer").alias("member")).union(d.select(F.lit("area"), "area")).union(f.select(F.lit("call"), "call_id"))
    side = lambda a, b, name: a.where("member IS NOT NULL").subtract(b.where("member IS NOT NULL")).withColumn("only_in", F.lit(name))
    return side(left, right, "evidence").union(side(right, left, "reference"))


CONTRACT_SETS = f"""WITH l AS (SELECT 'layer' AS kind, layer AS member FROM canonical_evidence UNION SELECT 'area', {areas.AREA_SQL} FROM canonical_evidence UNION SELECT 'call', funding_call_id FROM canonical_evidence WHERE funding_call_id <> ''),
    r AS (SELECT 'layer' AS kind, layer AS member FROM documents UNION SELECT 'area', {areas.AREA_SQL} FROM documents UNION SELECT 'call', call_id FROM funding_data)
    SELECT *, 'evidence' AS only_in FROM ((SELECT * FROM l WHERE member IS NOT NULL) EXCEPT (SELECT * FROM r WHERE member IS NOT NULL))
    UNION ALL SELECT *, 'reference' AS only_in FROM ((SELECT * FROM r WHERE member IS NOT NULL) EXCEPT (SELECT * FROM l WHERE member IS NOT NULL))"""


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Union by name of two tables with different columns, distinct, and the areas common to all."""
    c = table(spark, folder, "company_data", "url", areas.area(F.col("area")).alias("area"), "company_name")
    i = table(spark, folder, "investment_data", "url", areas.area(F.col("area")).alias("area"), F.col("title").alias("investment"))
    both = c.unionByName(i, allowMissingColumns=True).distinct()
    common = c.select("area").intersect(i.select("area"))
    return both.join(common, "area", "left_semi").groupBy("area").agg(F.count("*").alias("n"), F.count("company_name").alias("companies"), F.count("investment").alias("investments"))


_AREA = areas.AREA_SQL.replace("research_area", "area")
SET_OPERATIONS = f"""WITH c AS (SELECT url, {_AREA} AS a, company_name FROM company_data), i AS (SELECT url, {_AREA} AS a, title AS investment FROM investment_data),
    b AS (SELECT DISTINCT * FROM (SELECT url, a, company_name, NULL AS investment FROM c UNION ALL SELECT url, a, NULL, investment FROM i))
    SELECT a AS area, count(*) AS n, count(company_name) AS companies, count(investment) AS investments FROM b WHERE a IN (SELECT a FROM c INTERSECT SELECT a FROM i) GROUP BY a"""


def contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of the evidence hand-over that rows break, counted per rule and layer."""
    e = evidence(spark, folder, "evidence_id", "source_url", "layer", "confidence", "evidence_strength", "source_quality", "retrieved_at", "content_hash", "title", "problem", "normalization_status")
    bad_score = lambda c: F.col(c).isNotNull() & (F.isnan(c) | ~F.col(c).between(0.0, 1.0))
    rules = {
        "missing_id": F.col("evidence_id").isNull() | (F.col("evidence_id") == ""), "unusable_url": ~urls.usable(F.col("source_url")), "missing_layer": F.col("layer").isNull(),
        "bad_confidence": F.col("confidence").isNull() | bad_score("confidence"), "bad_strength": bad_score("evidence_strength"), "bad_quality": bad_score("source_quality"),
        "bad_stamp": F.try_to_timestamp("retrieved_at").isNull(), "naive_stamp": ~F.coalesce(F.col("retrieved_at").rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.lit(False)),
        "missing_hash": F.col("content_hash").isNull(), "missing_problem": F.coalesce(F.trim("problem"), F.lit("")) == "", "not_complete": F.coalesce("normalization_status", F.lit("")) != "complete",
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return e.select("layer", F.explode(broken).alias("rule")).groupBy("rule", "layer").agg(F.count("*").alias("n"))


CONTRACT_VIOLATIONS = """WITH v AS (SELECT layer, unnest([
      CASE WHEN evidence_id IS NULL OR evidence_id = '' THEN 'missing_id' END,
      CASE WHEN NOT coalesce(regexp_matches(lower(trim(source_url)), '^https?://[^/?#]+'), false) THEN 'unusable_url' END, CASE WHEN layer IS NULL THEN 'missing_layer' END,
      CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence NOT BETWEEN 0 AND 1 THEN 'bad_confidence' END, CASE WHEN isnan(evidence_strength) OR evidence_strength NOT BETWEEN 0 AND 1 THEN 'bad_strength' END,
      CASE WHEN isnan(source_quality) OR source_quality NOT BETWEEN 0 AND 1 THEN 'bad_quality' END, CASE WHEN TRY_CAST(retrieved_at AS TIMESTAMPTZ) IS NULL THEN 'bad_stamp' END,
      CASE WHEN NOT coalesce(regexp_matches(retrieved_at, '(?:Z|[+-]\\d{2}:?\\d{2})$'), false) THEN 'naive_stamp' END, CASE WHEN content_hash IS NULL THEN 'missing_hash' END,
      CASE WHEN coalesce(trim(problem), '') = '' THEN 'missing_problem' END, CASE WHEN coalesce(normalization_status, '') <> 'complete' THEN 'not_complete' END]) AS rule FROM canonical_evidence)
    SELECT rule, layer, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY rule, layer"""


def refresh_due(spark: SparkSession, folder: str) -> DataFrame:
    """Sites whose last fetch is older than their interval at as_of; the interval shrinks with trust."""
    as_of = F.lit("2026-01-01 00:00:00").cast(T.TimestampType())
    pages = table(spark, folder, "crawl_cache", urls.host(F.col("final_url")).alias("site"), F.try_to_timestamp("fetched_at").alias("t"), "status_code").where(F.col("site").isNotNull())
    s = pages.groupBy("site").agg(F.max("t").alias("last"), F.round(F.avg(F.when(F.col("status_code") < 400, 1.0).otherwise(0.0)), 6).alias("trust"))
    base = F.lit(30 * 86400.0) * F.when(F.col("trust") >= 0.9, 0.75).when(F.col("trust") < 0.6, 1.25).otherwise(1.0)
    age = (F.unix_seconds(as_of) - F.unix_seconds("last")).cast("double")
    return s.select("site", "trust", F.floor(base).alias("interval_s"), F.floor(age).alias("age_s"), (age >= base).alias("due"))


REFRESH_DUE = f"""WITH s AS (SELECT {HOST.format("final_url")} AS site, max(TRY_CAST(fetched_at AS TIMESTAMPTZ)) AS last, round(avg(CASE WHEN status_code < 400 THEN 1.0 ELSE 0.0 END), 6) AS trust FROM crawl_cache GROUP BY 1 HAVING site IS NOT NULL),
    b AS (SELECT site, trust, 2592000.0 * CASE WHEN trust >= 0.9 THEN 0.75 WHEN trust < 0.6 THEN 1.25 ELSE 1.0 END AS base, CAST(1767225600 - floor(epoch(last)) AS DOUBLE) AS age FROM s)
    SELECT site, trust, CAST(floor(base) AS BIGINT) AS interval_s, CAST(floor(age) AS BIGINT) AS age_s, age >= base AS due FROM b"""
QUERIES = {
    "observation_merge": (observation_merge, OBSERVATION_MERGE), "latest_per_key": (latest_per_key, LATEST_PER_KEY), "upsert_latest": (upsert_latest, UPSERT_LATEST), "insert_ignore": (insert_ignore, INSERT_IGNORE),
    "independence_group": (independence_group, INDEPENDENCE_GROUP), "registry_sync": (registry_sync, REGISTRY_SYNC), "discovery_candidates": (discovery_candidates, DISCOVERY_CANDIDATES),
    "cache_lookup": (cache_lookup, CACHE_LOOKUP), "trust_lookup": (trust_lookup, TRUST_LOOKUP), "review_queue": (review_queue, REVIEW_QUEUE), "attribution": (attribution, ATTRIBUTION),
    "contract_sets": (contract_sets, CONTRACT_SETS), "set_operations": (set_operations, SET_OPERATIONS), "contract_violations": (contract_violations, CONTRACT_VIOLATIONS), "refresh_due": (refresh_due, REFRESH_DUE),
}
