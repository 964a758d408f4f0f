"""Queries of enrichment joins, phrase windows, selections and blended scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import session
from siltstone.functions import areas, text, urls
from siltstone.operators import similarity
from siltstone.plans import gates
from siltstone.plans.merges import HOST, evidence
from siltstone.plans.similarity import _PROBLEMS_SQL, SOFT, _problems
from siltstone.sources.tables import table

AREA = areas.AREA_SQL
#: Synonyms that token comparison folds together: a parameter, here for the collection's prose.
SYNONYMS = {"reports": "report", "audits": "audit", "meters": "meter", "records": "record", "ledgers": "ledger", "registries": "registry"}


def bigrams(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 commonest word pairs of the problems, tokens folded by synonyms, once per distinct problem."""
    e = evidence(spark, folder, "problem").where("problem IS NOT NULL").distinct()
    words = e.select(F.transform(text.tokens_e(F.col("problem")), lambda w: areas.lookup(SYNONYMS, w, w)).alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(50)


BIGRAMS = f"""WITH e AS (SELECT DISTINCT problem FROM canonical_evidence WHERE problem IS NOT NULL), w AS (SELECT list_transform(regexp_extract_all(lower(problem), '[a-z0-9_]+'), lambda w: {areas.sql_case(SYNONYMS, "w", "w")}) AS w FROM e),
    p AS (SELECT unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS pair FROM w WHERE len(w) > 1) SELECT pair, count(*) AS n FROM p GROUP BY pair ORDER BY n DESC, pair LIMIT 50"""


def negation_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose problem names a term, and those that deny within 45 characters before it."""
    e = evidence(spark, folder, "evidence_id", F.lower("problem").alias("p")).where("p IS NOT NULL").distinct()
    terms = ("reserve", "ledger", "audit", "meter", "wallet")
    hit = F.array(*[F.struct(F.lit(t).alias("term"), F.col("p").contains(t).alias("hit"), F.col("p").rlike(rf"\b(?:no|not|cannot|couldn't|never|without|neither)\b[^.]{{0,45}}{t}").alias("denied")) for t in terms])
    return e.select(F.inline(hit)).where("hit").groupBy("term").agg(F.count("*").alias("rows"), F.count_if("denied").alias("denied"))


NEGATION_WINDOWS = (
    "WITH e AS (SELECT DISTINCT evidence_id, lower(problem) AS p FROM canonical_evidence WHERE problem IS NOT NULL), h AS ("
    + " UNION ALL ".join(rf"SELECT '{t}' AS term, regexp_matches(p, '\b(?:no|not|cannot|couldn''t|never|without|neither)\b[^.]{{0,45}}{t}') AS denied FROM e WHERE contains(p, '{t}')" for t in ("reserve", "ledger", "audit", "meter", "wallet"))
    + ") SELECT term, count(*) AS rows, count(*) FILTER (denied) AS denied FROM h GROUP BY term"
)


def problem_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The first sentence of a document of 40 to 320 characters and eight or more words that names a problem."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL")
    good = F.filter(F.transform(F.split("text", r"[.!?]+\s+|\n+"), lambda s: text.clean(s)), lambda s: F.length(s).between(40, 320) & (F.size(F.split(s, " ")) >= 8) & F.lower(s).rlike("suffers|missing|unclear|fail|lack|cannot|loss"))
    return d.select("doc_id", F.coalesce(F.get(good, F.lit(0)), F.lit("No explicit problem statement found.")).alias("problem"), F.size(good).cast("bigint").alias("candidates"))


PROBLEM_SELECTION = r"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\s+|\n+'), lambda s: trim(regexp_replace(s, '[ \t\n\r\f\v]+', ' ', 'g'))),
      lambda s: length(s) BETWEEN 40 AND 320 AND len(string_split(s, ' ')) >= 8 AND regexp_matches(lower(s), 'suffers|missing|unclear|fail|lack|cannot|loss')) AS good FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, coalesce(good[1], 'No explicit problem statement found.') AS problem, len(good) AS candidates FROM d"""


def tag_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence left-joined with its accepted tags (a list per record), counted per layer and number of tags."""
    tags = gates.tag_decisions(spark, folder).where("decision = 'accepted'").groupBy("evidence_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    rows = evidence(spark, folder, "evidence_id", "layer").distinct().join(tags, "evidence_id", "left")
    return rows.select("layer", F.coalesce("tags", F.lit("")).alias("tags")).groupBy("layer", "tags").agg(F.count("*").alias("n"))


TAG_ENRICHMENT = f"""WITH g AS (SELECT evidence_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM ({gates.TAG_DECISIONS}) WHERE decision = 'accepted' GROUP BY 1)
    SELECT layer, coalesce(tags, '') AS tags, count(*) AS n FROM (SELECT DISTINCT evidence_id, layer FROM canonical_evidence) LEFT JOIN g USING (evidence_id) GROUP BY ALL"""


def source_rescore(spark: SparkSession, folder: str) -> DataFrame:
    """Sites rescored from the evidence that cites them within a year before the newest row of all."""
    e = evidence(spark, folder, urls.host(F.col("source_url")).alias("site"), F.try_to_timestamp("retrieved_at").alias("t"), "layer", "evidence_id").where("site IS NOT NULL AND t IS NOT NULL").distinct()
    recent = e.where(F.col("t") >= e.agg(F.max("t")).scalar() - F.expr("interval 365 days"))
    g = recent.groupBy("site").agg(F.count("*").alias("n"), F.count_distinct("layer").alias("layers"))
    score = F.least(F.lit(0.95), 0.45 + 0.08 * F.least("n", F.lit(5)) + 0.04 * F.least("layers", F.lit(3)))
    return g.select("site", "n", "layers", F.round(score, 4).alias("relevance"), F.round(F.least(F.lit(0.95), 0.6 + 0.02 * F.least("n", F.lit(4))), 4).alias("trust"))


SOURCE_RESCORE = f"""WITH e AS (SELECT DISTINCT {HOST.format("source_url")} AS site, TRY_CAST(retrieved_at AS TIMESTAMPTZ) AS t, layer, evidence_id FROM canonical_evidence),
    f AS (SELECT * FROM e WHERE site IS NOT NULL AND t IS NOT NULL), g AS (SELECT site, count(*) AS n, count(DISTINCT layer) AS layers FROM f WHERE t >= (SELECT max(t) FROM f) - INTERVAL 365 DAY GROUP BY site)
    SELECT *, round(least(0.95, 0.45 + 0.08 * least(n, 5) + 0.04 * least(layers, 3)), 4) AS relevance, round(least(0.95, 0.6 + 0.02 * least(n, 4)), 4) AS trust FROM g"""


#: Points of the way in which a record was made (fixed values).
METHODS = {"manual_chat": 15, "local_llm": 10, "fallback": 5}


def confidence_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Per problem signature: capped sums of layers, records, sites, method and recency, and a label. Investment and
    hackathon layers alone give 10 points for layers and 40 in all; investment with one other layer 30, and 70 in all with none
    or one. The method is a record's normalization_status where that names one."""
    e = evidence(spark, folder, "problem_signature", F.lower(F.trim("layer")).alias("layer"), "evidence_id", "normalization_status", urls.host(F.col("source_url")).alias("site"), F.to_date(F.try_to_timestamp("retrieved_at")).alias("day")).where("problem_signature IS NOT NULL").distinct()
    method = areas.lookup(METHODS, F.lower(F.trim("normalization_status")), F.lit(0))
    research = F.when(~F.col("layer").isin("investment", "hackathon"), F.col("layer"))
    g = e.groupBy("problem_signature").agg(
        F.count_distinct("layer").alias("layers"), F.count_distinct(research).alias("research"), F.coalesce(F.max(F.col("layer") == "investment"), F.lit(False)).alias("invested"),
        F.count_distinct("evidence_id").alias("records"), F.count_distinct("site").alias("sites"), F.max(method).alias("method"), F.max("day").alias("day"),
    )
    age = F.datediff(F.lit("2026-01-01").cast("date"), F.col("day"))
    recency = F.when(age <= 30, 10).when(age <= 180, 7).when(age <= 365, 4).otherwise(0)
    alone = (F.col("layers") > 0) & (F.col("research") == 0)
    layers = F.least(20 * F.greatest("layers", F.lit(1)), F.when(alone, 10).when(F.col("invested") & (F.col("research") == 1), 30).otherwise(40))
    total = layers + F.least(10 * F.col("records"), F.lit(20)) + F.least(10 * F.col("sites"), F.lit(20)) + F.col("method") + recency
    capped = F.when(alone, F.least(total, F.lit(40))).when(F.col("invested") & (F.col("research") <= 1), F.least(total, F.lit(70))).otherwise(total)
    label = F.when(alone, "Low").when(F.col("invested") & (F.col("research") <= 1) & (total >= 70), "Medium").when(total >= 70, "High").when(total >= 45, "Medium").otherwise("Low")
    return g.select("problem_signature", capped.cast("bigint").alias("confidence"), label.alias("label"))


CONFIDENCE_BLEND = f"""WITH e AS (SELECT DISTINCT problem_signature, lower(trim(layer)) AS layer, evidence_id, {areas.sql_case(METHODS, "lower(trim(normalization_status))", "0")} AS m, {HOST.format("source_url")} AS site, CAST(TRY_CAST(retrieved_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS DATE) AS day FROM canonical_evidence WHERE problem_signature IS NOT NULL),
    g AS (SELECT problem_signature, count(DISTINCT layer) AS l, count(DISTINCT CASE WHEN layer NOT IN ('investment', 'hackathon') THEN layer END) AS q, coalesce(bool_or(layer = 'investment'), false) AS i, count(DISTINCT evidence_id) AS r, count(DISTINCT site) AS s, max(m) AS m, date_diff('day', max(day), DATE '2026-01-01') AS age FROM e GROUP BY 1),
    t AS (SELECT *, l > 0 AND q = 0 AS alone, least(20 * greatest(l, 1), CASE WHEN l > 0 AND q = 0 THEN 10 WHEN i AND q = 1 THEN 30 ELSE 40 END) + least(10 * r, 20) + least(10 * s, 20) + m + CASE WHEN age <= 30 THEN 10 WHEN age <= 180 THEN 7 WHEN age <= 365 THEN 4 ELSE 0 END AS c FROM g)
    SELECT problem_signature, CAST(CASE WHEN alone THEN least(c, 40) WHEN i AND q <= 1 THEN least(c, 70) ELSE c END AS BIGINT) AS confidence,
      CASE WHEN alone THEN 'Low' WHEN i AND q <= 1 AND c >= 70 THEN 'Medium' WHEN c >= 70 THEN 'High' WHEN c >= 45 THEN 'Medium' ELSE 'Low' END AS label FROM t"""


def cluster_scores(spark: SparkSession, folder: str) -> DataFrame:
    """V2, V3: of each problem's soft duplicates the best blended score: .65 cosine + .20 Jaccard + .075 + .075 for the area."""
    rows = session.cut(_problems(spark, folder))
    p = similarity.jaccard_pairs(rows, SOFT, ["area"])
    score = F.round(0.65 * similarity.pair_cosine(F.col("shared"), F.col("na"), F.col("nb")) + 0.20 * F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")) + 0.15, 6)
    both = p.select(F.explode(F.array("a", "b")).alias("id"), score.alias("score"))
    return both.groupBy("id").agg(F.max("score").alias("best"), F.count("*").alias("links"))


CLUSTER_SCORES = f"""WITH {_PROBLEMS_SQL},
    s AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS sh FROM x a JOIN x b ON a.area = b.area AND a.t = b.t AND a.id < b.id GROUP BY 1, 2),
    l AS (SELECT a, b, round(0.65 * sh / sqrt((sh + (na - sh) * pow(ln(1.5) + 1, 2)) * (sh + (nb - sh) * pow(ln(1.5) + 1, 2))) + 0.20 * sh / (na + nb - sh) + 0.15, 6) AS score FROM s WHERE sh >= 0.6 * (na + nb - sh) - 1e-9),
    u AS (SELECT a AS id, score FROM l UNION ALL SELECT b, score FROM l) SELECT id, max(score) AS best, count(*) AS links FROM u GROUP BY id"""


def query_match(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold two distinct terms of one query (never pooled over queries), per query."""
    queries = {"custody": ("custody", "key", "backup"), "grid": ("grid", "meter", "charging"), "trade": ("order", "liquidity", "auction")}
    d = table(spark, folder, "documents", "doc_id", F.lower("text").alias("t")).where("t IS NOT NULL")
    hits = F.array(*[F.struct(F.lit(q).alias("query"), sum((F.col("t").contains(w).cast("int") for w in words), F.lit(0)).alias("terms")) for q, words in queries.items()])
    return d.select("doc_id", F.inline(hits)).where("terms >= 2").groupBy("query").agg(F.count("*").alias("docs"), F.sum("terms").alias("terms"))


QUERY_MATCH = (
    "WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), h AS ("
    + " UNION ALL ".join(f"SELECT '{q}' AS query, {' + '.join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in ws)} AS n FROM d" for q, ws in (("custody", ("custody", "key", "backup")), ("grid", ("grid", "meter", "charging")), ("trade", ("order", "liquidity", "auction"))))
    + ") SELECT query, count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM h WHERE n >= 2 GROUP BY query"
)


def hashed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """V4: the non-semantic fallback vector of a document, of length 1: each distinct token adds a sign to one of 384 places.
    The place is the first four bytes of the token's SHA-256, low byte first, modulo 384; the sign is the fifth byte's last bit.
    Told by its number of filled places, its largest weight and the sum of place times weight."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL")
    t = d.select("doc_id", F.explode(text.tokens_a(F.col("text"))).alias("w")).withColumn("h", F.sha2("w", 256))
    byte = lambda k: F.conv(F.substring("h", 2 * k + 1, 2), 16, 10).cast("bigint")
    place = (byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216) % 384
    cells = t.groupBy("doc_id", place.alias("place")).agg(F.sum(F.when(byte(4) % 2 == 1, 1).otherwise(-1)).alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")))
    return cells.groupBy("doc_id").agg(F.count("*").alias("filled"), F.round(F.max(F.abs("v")) / norm, 6).alias("largest"), F.round(F.sum(F.col("place") * F.col("v")) / norm, 4).alias("moment"))


_BYTE = "CAST('0x' || substring(h, {}, 2) AS BIGINT)"
HASHED_VECTORS = f"""WITH t AS (SELECT doc_id, sha256(unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')))) AS h FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, ({_BYTE.format(1)} + {_BYTE.format(3)} * 256 + {_BYTE.format(5)} * 65536 + {_BYTE.format(7)} * 16777216) % 384 AS place, sum(CASE WHEN {_BYTE.format(9)} % 2 = 1 THEN 1 ELSE -1 END) AS v FROM t GROUP BY 1, 2)
    SELECT doc_id, count(*) AS filled, round(max(abs(v)) / sqrt(sum(v * v)), 6) AS largest, round(sum(place * v) / sqrt(sum(v * v)), 4) AS moment FROM c WHERE v <> 0 GROUP BY doc_id"""
QUERIES = {
    "bigrams": (bigrams, BIGRAMS), "negation_windows": (negation_windows, NEGATION_WINDOWS), "problem_selection": (problem_selection, PROBLEM_SELECTION), "tag_enrichment": (tag_enrichment, TAG_ENRICHMENT), "source_rescore": (source_rescore, SOURCE_RESCORE),
    "confidence_blend": (confidence_blend, CONFIDENCE_BLEND), "cluster_scores": (cluster_scores, CLUSTER_SCORES), "query_match": (query_match, QUERY_MATCH), "hashed_vectors": (hashed_vectors, HASHED_VECTORS),
}
