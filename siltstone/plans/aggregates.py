"""Queries of aggregations, windows, top-k and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import areas, text, urls
from siltstone.operators import trends
from siltstone.plans.merges import HOST, evidence
from siltstone.sources.tables import table

AREA = areas.AREA_SQL
MONTH = "strftime(coalesce(TRY_CAST(published_at AS TIMESTAMPTZ), TRY_CAST(retrieved_at AS TIMESTAMPTZ)) AT TIME ZONE 'UTC', '%Y-%m')"
area = lambda: areas.area(F.col("research_area")).alias("area")


def _month():
    return F.date_format(F.coalesce(F.try_to_timestamp("published_at"), F.try_to_timestamp("retrieved_at")), "yyyy-MM")


def corroboration_profile(spark: SparkSession, folder: str) -> DataFrame:
    """A2, A3: per problem: distinct sources, layers, research layers, and evidence units (groups, and sources outside any)."""
    e = evidence(spark, folder, "problem_signature", "source_id", "layer", "independence_group", "independence_status").distinct()
    grouped = F.when(F.col("independence_status") == "derived", F.col("independence_group"))
    per = e.withColumn("g", grouped).groupBy("problem_signature", "source_id").agg(F.max("g").alias("g"))
    units = per.groupBy("problem_signature").agg((F.count_distinct("g") + F.count_if(F.col("g").isNull() & F.col("source_id").isNotNull())).alias("units"))
    research = F.when(~F.col("layer").isin("Investment", "Hackathon"), F.col("layer"))
    out = e.groupBy("problem_signature").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), F.count_distinct("layer").alias("layers"), F.count_distinct(research).alias("research_layers"))
    out = out.join(units, out.problem_signature.eqNullSafe(units.problem_signature)).drop(units.problem_signature)
    return out.withColumn("ratio", F.round(F.col("units") / F.col("n"), 6))


CORROBORATION_PROFILE = """WITH e AS (SELECT DISTINCT problem_signature, source_id, layer, independence_group, independence_status FROM canonical_evidence),
    p AS (SELECT problem_signature, source_id, max(CASE WHEN independence_status = 'derived' THEN independence_group END) AS g FROM e GROUP BY ALL),
    u AS (SELECT problem_signature, count(DISTINCT g) + count(*) FILTER (g IS NULL AND source_id IS NOT NULL) AS units FROM p GROUP BY problem_signature),
    a AS (SELECT problem_signature, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT layer) AS layers, count(DISTINCT CASE WHEN layer NOT IN ('Investment', 'Hackathon') THEN layer END) AS research_layers FROM e GROUP BY problem_signature)
    SELECT a.*, u.units, round(u.units / n, 6) AS ratio FROM a JOIN u ON a.problem_signature IS NOT DISTINCT FROM u.problem_signature"""


def layer_area_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A5, A22, K7 and the cube extension: evidence per area and layer, with sub-totals."""
    return evidence(spark, folder, area(), "layer").cube("area", "layer").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


LAYER_AREA_COUNTS = f"SELECT {AREA} AS area, layer, count(*) AS n, CAST(grouping({AREA}, layer) AS BIGINT) AS level FROM canonical_evidence GROUP BY CUBE ({AREA}, layer)"


def monthly_series(spark: SparkSession, folder: str) -> DataFrame:
    """Independent sources per area and month, dense."""
    counts = evidence(spark, folder, area(), _month().alias("month"), "source_id").where("month IS NOT NULL AND area IS NOT NULL").groupBy("area", "month").agg(F.count_distinct("source_id").alias("units"))
    return trends.dense_months(counts, "area", "month", "units")


MONTHLY_SERIES = f"""WITH c AS (SELECT {AREA} AS area, {MONTH} AS month, count(DISTINCT source_id) AS units FROM canonical_evidence GROUP BY 1, 2 HAVING area IS NOT NULL AND month IS NOT NULL),
    s AS (SELECT strftime(unnest(generate_series(min(month || '-01')::DATE, max(month || '-01')::DATE, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM c),
    g AS (SELECT * FROM (SELECT DISTINCT area FROM c) CROSS JOIN s)
    SELECT area, month, coalesce(units, 0) AS units FROM g LEFT JOIN c USING (area, month)"""


def trend_direction(spark: SparkSession, folder: str) -> DataFrame:
    """Direction and confidence of each area's series, with the independence and research layers of its last month."""
    e = evidence(spark, folder, area(), _month().alias("month"), "source_id", "evidence_id", "layer").where("month IS NOT NULL AND area IS NOT NULL")
    research = F.when(~F.lower("layer").isin("investment", "hackathon"), F.lower("layer"))
    support = e.groupBy("area", "month").agg((F.count_distinct("source_id") / F.count_distinct("evidence_id")).alias("independence"), F.count_distinct(research).alias("layers"))
    return trends.direction(monthly_series(spark, folder), "area", "month", "units", support)


TREND_DIRECTION = f"""WITH m AS ({MONTHLY_SERIES}), w AS (SELECT area, month, CAST(units AS DOUBLE) AS v0, lag(CAST(units AS DOUBLE)) OVER o AS v1, lag(CAST(units AS DOUBLE), 2) OVER o AS v2,
      avg(units) OVER (PARTITION BY area ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean, count(*) OVER o AS n FROM m WINDOW o AS (PARTITION BY area ORDER BY month)),
    l AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY month DESC) AS r FROM w),
    q AS (SELECT {AREA} AS area, {MONTH} AS month, count(DISTINCT source_id) / count(DISTINCT evidence_id) AS ind, count(DISTINCT CASE WHEN lower(layer) NOT IN ('investment', 'hackathon') THEN lower(layer) END) AS ly FROM canonical_evidence GROUP BY 1, 2),
    d AS (SELECT area, month, n, ind, ly, (v0 - v1) / greatest(v1, 1.0) AS g, (v1 - v2) / greatest(v2, 1.0) AS pg, ((v0 - v1) - (v1 - v2)) / greatest(v1, 1.0) AS a, (v0 - mean) / greatest(mean, 1.0) AS b FROM l LEFT JOIN q USING (area, month) WHERE r = 1),
    f AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient_history' WHEN g >= 0.5 AND a >= 0.25 THEN 'accelerating' WHEN g >= 0.25 AND b >= 0.25 AND a >= 0.10 THEN 'rising' WHEN g <= -0.25 AND a <= -0.10 THEN 'declining'
           WHEN abs(g) <= 0.15 AND abs(b) <= 0.20 THEN 'stable' ELSE 'ambiguous' END AS direction FROM d)
    SELECT area, month, round(g, 6) AS growth, round(pg, 6) AS previous_growth, round(a, 6) AS acceleration, round(b, 6) AS baseline, n AS months, direction,
           round(coalesce(CASE WHEN n < 3 THEN NULL WHEN direction IN ('accelerating', 'rising', 'declining', 'stable') THEN 1.0 ELSE 0.35 END * (0.25 * least(1.0, abs(g)) + 0.20 * least(1.0, abs(b)) + 0.20 * least(1.0, coalesce(ind, 0)) + 0.20 * least(1.0, coalesce(ly, 0) / 3.0) + 0.15 * least(1.0, n / 8.0)), 0.0), 6) AS confidence FROM f"""


def topic_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 commonest tokens of each area, counted once per distinct problem."""
    e = evidence(spark, folder, area(), "problem").where("problem IS NOT NULL AND area IS NOT NULL").distinct()
    counts = e.select("area", F.explode(text.tokens_a(F.col("problem"))).alias("term")).where(F.length("term") > 3).groupBy("area", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("area").orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 20")


TOPIC_COUNTS = f"""WITH e AS (SELECT DISTINCT {AREA} AS area, problem FROM canonical_evidence WHERE problem IS NOT NULL),
    t AS (SELECT area, unnest(list_distinct(regexp_extract_all(lower(problem), '[a-z0-9]{{3,}}'))) AS term FROM e WHERE area IS NOT NULL),
    c AS (SELECT area, term, count(*) AS n FROM t WHERE length(term) > 3 GROUP BY area, term),
    r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY n DESC, term) AS rank FROM c) SELECT * FROM r WHERE rank <= 20"""


def emerging_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Title tokens by how far their count in the latest year exceeds the mean over all prior years; top 25."""
    calls = table(spark, folder, "funding_data", "year", "title").where("year IS NOT NULL AND title IS NOT NULL")
    terms = calls.select("year", F.explode(text.tokens_a(F.col("title"))).alias("term")).groupBy("year", "term").agg(F.count("*").alias("n"))
    latest, prior = calls.agg(F.max("year")).scalar(), calls.agg(F.count_distinct("year") - 1).scalar()
    t = terms.withColumns({"latest": latest, "prior": prior})
    now, before = F.sum(F.when(F.col("year") == F.col("latest"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("year") < F.col("latest"), F.col("n")).otherwise(0))
    out = t.groupBy("term").agg(now.alias("now"), before.alias("before"), F.max("prior").alias("prior"))
    delta = F.col("now") - F.col("before") / F.greatest(F.col("prior"), F.lit(1))
    return out.select("term", "now", "before", F.round(delta, 6).alias("delta")).where("delta > 0").orderBy(F.desc("delta"), "term").limit(25)


EMERGING_TERMS = """WITH c AS (SELECT year, title FROM funding_data WHERE year IS NOT NULL AND title IS NOT NULL), s AS (SELECT max(year) AS latest, count(DISTINCT year) - 1 AS prior FROM c),
    t AS (SELECT year, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{3,}'))) AS term FROM c),
    o AS (SELECT term, CAST(sum(CASE WHEN year = latest THEN 1 ELSE 0 END) AS BIGINT) AS now, CAST(sum(CASE WHEN year < latest THEN 1 ELSE 0 END) AS BIGINT) AS before, max(prior) AS prior FROM t CROSS JOIN s GROUP BY term)
    SELECT term, now, before, round(now - before / greatest(prior, 1), 6) AS delta FROM o WHERE now - before / greatest(prior, 1) > 0 ORDER BY delta DESC, term LIMIT 25"""


def source_health(spark: SparkSession, folder: str) -> DataFrame:
    """Per fetch method: pages by class of status (zero-filled), mean age, attention score."""
    pages = table(spark, folder, "crawl_cache", "fetch_method", "status_code", "url").withColumn("cls", F.concat(F.floor(F.col("status_code") / 100).cast("string"), F.lit("xx")))
    wide = pages.groupBy("fetch_method").pivot("cls", ["2xx", "3xx", "4xx", "5xx"]).agg(F.count("url")).na.fill(0)
    total = F.col("2xx") + F.col("3xx") + F.col("4xx") + F.col("5xx")
    return wide.select("fetch_method", F.col("2xx").alias("ok"), F.col("3xx").alias("moved"), F.col("4xx").alias("gone"), F.col("5xx").alias("down"), F.round((F.col("4xx") + 2 * F.col("5xx")) / total, 6).alias("attention"))


SOURCE_HEALTH = """WITH p AS (SELECT fetch_method, count(url) FILTER (status_code // 100 = 2) AS ok, count(url) FILTER (status_code // 100 = 3) AS moved, count(url) FILTER (status_code // 100 = 4) AS gone,
    count(url) FILTER (status_code // 100 = 5) AS down FROM crawl_cache GROUP BY fetch_method) SELECT *, round((gone + 2 * down) / (ok + moved + gone + down), 6) AS attention FROM p"""


def quality_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios over all evidence, rounded to four places, 0 without a denominator."""
    e = evidence(spark, folder, "evidence_excerpt", "published_at", "independence_status", "normalization_status", "source_url", "confidence")
    ratio = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0)), 4)
    return e.agg(
        F.count("*").alias("total"), ratio(F.col("evidence_excerpt").isNotNull()).alias("with_excerpt"), ratio(F.try_to_timestamp("published_at").isNotNull()).alias("dated"),
        ratio(F.col("independence_status") == "independent").alias("independent"), ratio(F.col("normalization_status") == "complete").alias("complete"),
        ratio(urls.usable(F.col("source_url"))).alias("usable_url"), ratio(F.col("confidence") >= 0.7).alias("confident"),
    )


QUALITY_METRICS = """SELECT count(*) AS total, round(avg(CASE WHEN evidence_excerpt IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS with_excerpt, round(avg(CASE WHEN TRY_CAST(published_at AS TIMESTAMPTZ) IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS dated,
    round(avg(CASE WHEN independence_status = 'independent' THEN 1.0 ELSE 0.0 END), 4) AS independent, round(avg(CASE WHEN normalization_status = 'complete' THEN 1.0 ELSE 0.0 END), 4) AS complete,
    round(avg(CASE WHEN regexp_matches(lower(trim(source_url)), '^https?://[^/?#]+') THEN 1.0 ELSE 0.0 END), 4) AS usable_url, round(avg(CASE WHEN confidence >= 0.7 THEN 1.0 ELSE 0.0 END), 4) AS confident FROM canonical_evidence"""


def regression_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per run and their change against the previous run of the layer."""
    runs = evidence(spark, folder, "layer", "run_id", "confidence").where("run_id IS NOT NULL").groupBy("layer", "run_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
    w = Window.partitionBy("layer").orderBy("run_id")
    return runs.select("layer", "run_id", "n", (F.col("n") - F.lag("n").over(w)).alias("n_delta"), F.round(F.col("confidence") - F.lag("confidence").over(w), 6).alias("confidence_delta"))


REGRESSION_DIFF = """WITH r AS (SELECT layer, run_id, count(*) AS n, round(avg(confidence), 6) AS c FROM canonical_evidence WHERE run_id IS NOT NULL GROUP BY ALL)
    SELECT layer, run_id, n, n - lag(n) OVER w AS n_delta, round(c - lag(c) OVER w, 6) AS confidence_delta FROM r WINDOW w AS (PARTITION BY layer ORDER BY run_id)"""


def majority_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs in which a majority of the twelve collectors delivered, and URLs fetched more than once per run."""
    runs = evidence(spark, folder, "run_id", "agent", "source_url").groupBy("run_id").agg(F.count_distinct("agent").alias("agents"), (F.count("source_url") - F.count_distinct("source_url")).alias("repeats"))
    return runs.where((F.col("agents") * 2 > 12) | (F.col("repeats") > 0))


MAJORITY_RUNS = "SELECT run_id, count(DISTINCT agent) AS agents, count(source_url) - count(DISTINCT source_url) AS repeats FROM canonical_evidence GROUP BY run_id HAVING agents * 2 > 12 OR repeats > 0"


def mode_area(spark: SparkSession, folder: str) -> DataFrame:
    """Dominant area per source (lowest label on a tie), with its sorted facets."""
    e = evidence(spark, folder, "source_name", area(), "evidence_type", "layer")
    counts = e.where("area IS NOT NULL").groupBy("source_name", "area").agg(F.count("*").alias("n"))
    best = counts.groupBy("source_name").agg(F.min(F.struct((-F.col("n")).alias("k"), "area")).alias("b"))
    facets = e.groupBy("source_name").agg(F.array_join(F.array_sort(F.collect_set("evidence_type")), ",").alias("types"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))
    out = facets.join(best, facets.source_name.eqNullSafe(best.source_name), "left").drop(best.source_name)
    return out.select("source_name", F.col("b.area").alias("area"), (-F.col("b.k")).alias("n"), "types", "layers")


MODE_AREA = f"""WITH c AS (SELECT source_name, {AREA} AS area, count(*) AS n FROM canonical_evidence GROUP BY 1, 2 HAVING area IS NOT NULL),
    b AS (SELECT source_name, area, n, row_number() OVER (PARTITION BY source_name ORDER BY n DESC, area) AS r FROM c),
    f AS (SELECT source_name, array_to_string(list_sort(list_distinct(list(evidence_type))), ',') AS types, array_to_string(list_sort(list_distinct(list(layer))), ',') AS layers FROM canonical_evidence GROUP BY 1)
    SELECT f.source_name, area, n, coalesce(types, '') AS types, coalesce(layers, '') AS layers FROM f LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON f.source_name IS NOT DISTINCT FROM b.source_name"""


def polarity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per problem signature: rows of negative and of positive wording, and whether both occur."""
    e = evidence(spark, folder, "problem_signature", "problem").where("problem IS NOT NULL").distinct()
    neg, pos = F.lower("problem").rlike("suffers|fail|lack|cannot|missing|incomplete|unclear"), F.lower("problem").rlike("could reduce|helps|support|improve|contain")
    out = e.groupBy("problem_signature").agg(F.count_if(neg).alias("negative"), F.count_if(pos).alias("positive"))
    return out.withColumn("tension", (F.col("negative") > 0) & (F.col("positive") > 0))


POLARITY_COUNTS = """WITH e AS (SELECT DISTINCT problem_signature, lower(problem) AS p FROM canonical_evidence WHERE problem IS NOT NULL),
    c AS (SELECT problem_signature, count(*) FILTER (regexp_matches(p, 'suffers|fail|lack|cannot|missing|incomplete|unclear')) AS negative, count(*) FILTER (regexp_matches(p, 'could reduce|helps|support|improve|contain')) AS positive FROM e GROUP BY 1)
    SELECT *, negative > 0 AND positive > 0 AS tension FROM c"""


def ranking_index(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best evidence rows of each area by strength, quality and title."""
    e = evidence(spark, folder, area(), "evidence_id", "title", "evidence_strength", "source_quality").where("area IS NOT NULL").distinct()
    score = F.round(0.6 * F.coalesce("evidence_strength", F.lit(0.0)) + 0.4 * F.coalesce("source_quality", F.lit(0.0)), 6)
    w = Window.partitionBy("area").orderBy(F.desc("score"), F.asc_nulls_first("title"), "evidence_id")
    return e.withColumn("score", score).withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 10").select("area", "rank", "evidence_id", "score")


RANKING_INDEX = f"""WITH e AS (SELECT DISTINCT {AREA} AS area, evidence_id, title, evidence_strength, source_quality FROM canonical_evidence),
    s AS (SELECT *, round(0.6 * coalesce(evidence_strength, 0) + 0.4 * coalesce(source_quality, 0), 6) AS score FROM e WHERE area IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY score DESC, title NULLS FIRST, evidence_id) AS rank FROM s) SELECT area, rank, evidence_id, score FROM r WHERE rank <= 10"""


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ps): the paragraphs of every document that are not blank; a text without blank lines is one."""
    docs = table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL")
    return docs.select("doc_id", F.filter(F.split(F.replace("text", F.lit("\r"), F.lit("")), r"\n\n+"), lambda p: F.trim(p) != "").alias("ps"))


def excerpt_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph of a document with its neighbours, cut to 600 characters; within the row, so nothing is moved."""
    around = lambda p, i: F.left(F.concat_ws(" ", F.get("ps", i - 1), p, F.get("ps", i + 1)), F.lit(600))
    rows = _paragraphs(spark, folder).select("doc_id", F.posexplode(F.transform("ps", around)).alias("pos", "window"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "window")


EXCERPT_WINDOWS = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, chr(13), ''), '\n\n+'), lambda p: trim(p) <> '') AS ps FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS para FROM d)
    SELECT doc_id, pos, substring(concat_ws(' ', lag(para) OVER w, para, lead(para) OVER w), 1, 600) AS "window" FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""


def focused_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The two paragraphs of each document with most digits and capitals, and their neighbours, in page order."""
    ranked = F.array_sort(F.transform("ps", lambda p, i: F.struct((-F.length(F.regexp_replace(p, "[^0-9A-Z]", ""))).alias("score"), (-F.length(p)).alias("size"), i.alias("pos"))))
    top = F.transform(F.slice(ranked, 1, 2), lambda x: x["pos"])
    rows = _paragraphs(spark, folder).select("doc_id", "ps", top.alias("top"))
    kept = F.filter(F.transform("ps", lambda p, i: F.struct(i.cast("bigint").alias("pos"), F.sha2(p, 256).alias("block"))), lambda x: F.exists("top", lambda t: F.abs(t - x["pos"]) <= 1))
    return rows.select("doc_id", F.inline(kept))


FOCUSED_BLOCKS = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, chr(13), ''), '\n\n+'), lambda p: trim(p) <> '') AS ps FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS para FROM d), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(regexp_replace(para, '[^0-9A-Z]', '', 'g')) DESC, length(para) DESC, pos) AS r FROM p),
    n AS (SELECT DISTINCT doc_id, unnest([pos - 1, pos, pos + 1]) AS pos FROM s WHERE r <= 2) SELECT doc_id, pos, sha256(para) AS block FROM p JOIN n USING (doc_id, pos)"""


def orders_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Grouping sets: revenue by region, nation and year, rolled up, over the star schema."""
    li = table(spark, folder, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    c = table(spark, folder, "customer", "c_custkey", "c_nationkey")
    n = table(spark, folder, "nation", "n_nationkey", "n_name", "n_regionkey").join(F.broadcast(table(spark, folder, "region", "r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "year").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


ORDERS_ROLLUP = """SELECT r_name AS region, n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name, year)"""


def source_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Per funding call the ordered distinct union of layers and the first three sources by stamp."""
    e = evidence(spark, folder, "funding_call_id", "layer", "source_id", "retrieved_at").where("funding_call_id <> '' AND source_id IS NOT NULL").distinct()
    first = e.groupBy("funding_call_id", "source_id").agg(F.min("retrieved_at").alias("t"))
    w = Window.partitionBy("funding_call_id").orderBy(F.asc_nulls_first("t"), "source_id")
    top = first.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("funding_call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "source_id"))), lambda s: s["source_id"]), "|").alias("sources"))
    layers = e.groupBy("funding_call_id").agg(F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"), F.count_distinct("source_id").alias("n_sources"))
    return layers.join(top, "funding_call_id")


SOURCE_BUNDLE = """WITH e AS (SELECT DISTINCT funding_call_id, layer, source_id, retrieved_at FROM canonical_evidence WHERE funding_call_id <> '' AND source_id IS NOT NULL),
    f AS (SELECT funding_call_id, source_id, min(retrieved_at) AS t FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY funding_call_id ORDER BY t NULLS FIRST, source_id) AS r FROM f),
    t AS (SELECT funding_call_id, string_agg(source_id, '|' ORDER BY r) AS sources FROM r WHERE r <= 3 GROUP BY 1)
    SELECT funding_call_id, array_to_string(list_sort(list_distinct(list(layer))), ',') AS layers, count(DISTINCT source_id) AS n_sources, any_value(sources) AS sources FROM e JOIN t USING (funding_call_id) GROUP BY funding_call_id"""


def pending_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence whose page is not cached, per layer and area, with the share of the layer."""
    e = evidence(spark, folder, "evidence_id", "layer", area(), "source_url").distinct()
    pages = table(spark, folder, "crawl_cache", F.col("url").alias("source_url")).distinct()
    open_ = e.join(pages, "source_url", "left_anti").groupBy("layer", "area").agg(F.count("*").alias("pending"))
    total = e.groupBy("layer").agg(F.count("*").alias("t"))
    out = open_.join(total, open_.layer.eqNullSafe(total.layer)).drop(total.layer)
    return out.select("layer", "area", "pending", F.round(F.col("pending") / F.col("t"), 6).alias("share"))


PENDING_SOURCES = f"""WITH e AS (SELECT DISTINCT evidence_id, layer, {AREA} AS area, source_url FROM canonical_evidence), o AS (SELECT layer, area, count(*) AS pending FROM e
      WHERE NOT EXISTS (SELECT 1 FROM crawl_cache c WHERE c.url = e.source_url) GROUP BY layer, area), t AS (SELECT layer, count(*) AS t FROM e GROUP BY layer)
    SELECT o.layer, area, pending, round(pending / t, 6) AS share FROM o JOIN t ON o.layer IS NOT DISTINCT FROM t.layer"""
QUERIES = {
    "corroboration_profile": (corroboration_profile, CORROBORATION_PROFILE), "layer_area_counts": (layer_area_counts, LAYER_AREA_COUNTS), "monthly_series": (monthly_series, MONTHLY_SERIES),
    "trend_direction": (trend_direction, TREND_DIRECTION), "topic_counts": (topic_counts, TOPIC_COUNTS), "emerging_terms": (emerging_terms, EMERGING_TERMS), "source_health": (source_health, SOURCE_HEALTH),
    "quality_metrics": (quality_metrics, QUALITY_METRICS), "regression_diff": (regression_diff, REGRESSION_DIFF), "majority_runs": (majority_runs, MAJORITY_RUNS), "mode_area": (mode_area, MODE_AREA),
    "polarity_counts": (polarity_counts, POLARITY_COUNTS), "ranking_index": (ranking_index, RANKING_INDEX), "excerpt_windows": (excerpt_windows, EXCERPT_WINDOWS), "focused_blocks": (focused_blocks, FOCUSED_BLOCKS),
    "orders_rollup": (orders_rollup, ORDERS_ROLLUP), "source_bundle": (source_bundle, SOURCE_BUNDLE), "pending_sources": (pending_sources, PENDING_SOURCES),
}
