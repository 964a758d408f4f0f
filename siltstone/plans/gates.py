"""Queries of predicates, rule classifiers and scorers over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import areas, text
from siltstone.plans.merges import evidence
from siltstone.plans.scalars import CLEAN
from siltstone.sources.tables import table

AREA = areas.AREA_SQL
#: Weighted terms per area: the vocabulary is a parameter; this one fits the collection's prose.
AREA_TERMS = {
    "RWA": {"land title": 3, "warehouse receipt": 3, "bond ledger": 2, "collateral": 2, "invoice": 1}, "ESG": {"emission": 3, "carbon": 3, "disclosure report": 2, "energy": 1},
    "ZK-IoV": {"proof circuit": 3, "roadside unit": 3, "vehicle": 2, "signature": 1}, "DID": {"identity wallet": 3, "credential": 3, "consent": 2, "registry": 1},
    "DePIN": {"sensor": 3, "storage node": 2, "charging hub": 2, "spectrum": 2, "mapping service": 1}, "MEV": {"mempool": 3, "order router": 3, "block builder": 3, "front running": 2, "sequencer": 2},
    "Stablecoins": {"peg mechanism": 3, "redemption": 3, "reserve": 2, "custody": 1},
}
#: Tags, their terms and the layers whose records speak for them outright.
TAGS = {"#custody": ("custody", "key", "backup"), "#disclosure": ("disclosure", "report", "audit"), "#liquidity": ("liquidity", "redemption", "market"), "#identity": ("identity", "credential", "wallet"), "#energy": ("energy", "emission", "meter")}


def area_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of every document by weighted phrase hits: score = raw / max(4, sum of all), the best three."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", text.padded(F.col("text")).alias("pad"))
    raw = {a: sum((text.phrase_count(F.col("pad"), t) * w for t, w in terms.items()), F.lit(0)) for a, terms in AREA_TERMS.items()}
    wide = d.select("doc_id", *[c.alias(f"r{i}") for i, c in enumerate(raw.values())])
    total = sum((F.col(f"r{i}") for i in range(len(raw))), F.lit(0))
    scored = F.array(*[F.struct((-F.round(F.col(f"r{i}") / F.greatest(F.lit(4), total), 6)).alias("k"), F.lit(a).alias("area"), F.col(f"r{i}").alias("raw")) for i, a in enumerate(raw)])
    # Ranking within the row needs no shuffle.
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["raw"] > 0)), 1, 3)
    rows = wide.select("doc_id", F.posexplode(best).alias("pos", "s"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "s.area", F.col("s.raw").alias("raw"), (-F.col("s.k")).alias("score"))


def _pad_hit(term: str) -> str:
    needle = " " + "  ".join(term.split()) + " "
    return f"CAST((length(pad) - length(replace(pad, '{needle}', ''))) / {len(needle)} AS BIGINT)"


AREA_RANK = (
    "WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '  ') || ' ' AS pad FROM documents WHERE text IS NOT NULL), r AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{a}' AS area, {' + '.join(f'{w} * {_pad_hit(t)}' for t, w in terms.items())} AS raw FROM d" for a, terms in AREA_TERMS.items())
    + "), t AS (SELECT *, sum(raw) OVER (PARTITION BY doc_id) AS total FROM r), s AS (SELECT doc_id, area, raw, round(raw / greatest(4, total), 6) AS score FROM t WHERE raw > 0), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, area) AS rank FROM s) SELECT * FROM k WHERE rank <= 3"
)


def tag_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of every evidence row: strength of its hits, quality of its fields, confidence and decision."""
    e = evidence(spark, folder, "evidence_id", "problem", "evidence_excerpt", "source_url", "published_at", "title").where("problem IS NOT NULL").distinct()
    e = e.select("*", text.tokens_a(F.col("problem")).alias("tk"), text.tokens_a(F.coalesce("title", F.lit(""))).alias("tt"))
    quality = 0.55 + 0.20 * F.col("evidence_excerpt").isNotNull().cast("double") + 0.10 * F.col("source_url").isNotNull().cast("double") + 0.10 * F.try_to_timestamp("published_at").isNotNull().cast("double")
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), F.array(*[F.lit(w) for w in words]).alias("words")) for t, words in TAGS.items()])
    rows = e.select("evidence_id", "tk", "tt", quality.alias("quality"), F.inline(tags))
    hits, explicit = F.size(F.array_intersect("tk", "words")), F.size(F.array_intersect("tt", "words")) > 0
    strength = F.when(hits == 0, 0.0).otherwise(0.45 + F.least(F.lit(0.30), 0.10 * hits) + F.when(explicit, 0.20).otherwise(0.05))
    sure = 0.30 * strength + 0.20 * explicit.cast("double") + 0.15 * F.least(F.lit(1.0), hits / 2.0) + 0.10 * F.col("quality") + F.when(explicit, 0.05).otherwise(0.03)
    rows = rows.withColumns({"hits": hits.cast("bigint"), "confidence": F.round(sure, 6)}).where("hits > 0")
    return rows.select("evidence_id", "tag", "hits", "confidence", F.when(F.col("confidence") >= 0.45, "accepted").when(F.col("confidence") >= 0.35, "candidate").otherwise("rejected").alias("decision"))


TAG_DECISIONS = (
    "WITH e AS (SELECT DISTINCT evidence_id, problem, evidence_excerpt, source_url, published_at, title FROM canonical_evidence WHERE problem IS NOT NULL), k AS (SELECT evidence_id, list_distinct(regexp_extract_all(lower(problem), '[a-z0-9]{3,}')) AS tk, "
    "list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]{3,}')) AS tt, 0.55 + CASE WHEN evidence_excerpt IS NOT NULL THEN 0.20 ELSE 0 END + CASE WHEN source_url IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN TRY_CAST(published_at AS TIMESTAMPTZ) IS NOT NULL THEN 0.10 ELSE 0 END AS quality FROM e), "
    "t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, {list(w)} AS words" for t, w in TAGS.items()) + "), h AS (SELECT evidence_id, tag, len(list_intersect(tk, words)) AS hits, len(list_intersect(tt, words)) > 0 AS ex, quality FROM k CROSS JOIN t), "
    "c AS (SELECT evidence_id, tag, hits, round(0.30 * (0.45 + least(0.30, 0.10 * hits) + CASE WHEN ex THEN 0.20 ELSE 0.05 END) + CASE WHEN ex THEN 0.20 ELSE 0 END + 0.15 * least(1.0, hits / 2.0) + 0.10 * quality + CASE WHEN ex THEN 0.05 ELSE 0.03 END, 6) AS confidence FROM h WHERE hits > 0) "
    "SELECT *, CASE WHEN confidence >= 0.45 THEN 'accepted' WHEN confidence >= 0.35 THEN 'candidate' ELSE 'rejected' END AS decision FROM c"
)


def _five(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(x, F.lit(5)))


def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Collection quality of every document: four dimensions of 0 to 5, total, reasons and pass."""
    t = F.col("text")
    d = table(spark, folder, "documents", "doc_id", "text", "url", "title", "research_area").where("text IS NOT NULL")
    low = F.lower(text.clean(t))
    area = _five(F.when(F.col("research_area").isNotNull() & (F.lower("research_area") != "unscoped"), 4).otherwise(1))
    depth = F.size(F.filter(F.split(F.regexp_extract(F.coalesce("url", F.lit("")), r"^https?://[^/]+/(.*)$", 1), "/"), lambda s: s != ""))
    specific = _five(depth + 1)
    density = _five(F.size(F.regexp_extract_all(low, F.lit("suffers|missing|incomplete|unclear|fail|lack|cannot|loss"), 0)))
    rich = _five(F.floor(F.length(low) / 300).cast("int"))
    total = F.floor((30 * area + 20 * specific + 25 * density + 25 * rich) / 5).cast("bigint")
    generic = F.lower(F.trim(F.coalesce("title", F.lit("")))).isin("", "home", "index", "untitled", "overview")
    rows = d.select("doc_id", area.alias("area_fit"), specific.alias("specificity"), density.alias("density"), rich.alias("richness"), total.alias("total"), F.length(low).alias("n"), generic.alias("generic"))
    reasons = F.array_compact(F.array(F.when(F.col("n") < 80, "too_short"), F.when(F.col("generic"), "generic_title"), F.when(F.col("density") == 0, "no_problem_signal"), F.when(F.col("total") < 45, "low_total")))
    return rows.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("area_fit", "specificity", "density", "richness")], "total", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


QUALITY_GATE = rf"""WITH d AS (SELECT doc_id, lower({CLEAN.format("text")}) AS low, coalesce(url, '') AS url, lower(trim(coalesce(title, ''))) AS title, research_area FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, low, title, CASE WHEN research_area IS NOT NULL AND lower(research_area) <> 'unscoped' THEN 4 ELSE 1 END AS area_fit,
          least(5, 1 + len(list_filter(string_split(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '/'), lambda s: s <> ''))) AS specificity,
          least(5, len(regexp_extract_all(low, 'suffers|missing|incomplete|unclear|fail|lack|cannot|loss'))) AS density, least(5, length(low) // 300) AS richness FROM d),
    t AS (SELECT *, (30 * area_fit + 20 * specificity + 25 * density + 25 * richness) // 5 AS total FROM s),
    r AS (SELECT *, concat_ws(',', CASE WHEN length(low) < 80 THEN 'too_short' END, CASE WHEN title IN ('', 'home', 'index', 'untitled', 'overview') THEN 'generic_title' END, CASE WHEN density = 0 THEN 'no_problem_signal' END, CASE WHEN total < 45 THEN 'low_total' END) AS reasons FROM t)
    SELECT doc_id, CAST(area_fit AS BIGINT) AS area_fit, CAST(specificity AS BIGINT) AS specificity, CAST(density AS BIGINT) AS density, CAST(richness AS BIGINT) AS richness, CAST(total AS BIGINT) AS total, reasons, reasons = '' AS passed FROM r"""


def claim_support(spark: SparkSession, folder: str) -> DataFrame:
    """How much of a problem's tokens its evidence holds; echo: the evidence says nothing but the title."""
    e = evidence(spark, folder, "evidence_id", "problem", "evidence", "title").where("problem IS NOT NULL AND evidence IS NOT NULL").distinct()
    e = e.withColumns({n: text.tokens_a(F.coalesce(c, F.lit(""))) for n, c in (("p", "problem"), ("v", "evidence"), ("t", "title"))})
    p, v, t = F.col("p"), F.col("v"), F.col("t")
    words = F.filter(p, lambda w: (F.length(w) > 4) | w.rlike("^[0-9]+$"))
    held = F.filter(words, lambda w: F.exists(v, lambda x: (x == w) | (F.length(w) > 5) & (F.left(x, F.length(w) - 1) == F.left(w, F.length(w) - 1))))
    return e.select(
        "evidence_id", "problem", F.size(words).cast("bigint").alias("words"), F.size(held).cast("bigint").alias("held"), (F.size(held) == F.size(words)).alias("supported"),
        ((F.size(v) >= 3) & (F.size(F.array_except(v, t)) == 0)).alias("echo"),
    )


CLAIM_SUPPORT = """WITH e AS (SELECT DISTINCT evidence_id, problem, evidence, title FROM canonical_evidence WHERE problem IS NOT NULL AND evidence IS NOT NULL),
    k AS (SELECT evidence_id, problem, list_filter(list_distinct(regexp_extract_all(lower(problem), '[a-z0-9]{3,}')), lambda w: length(w) > 4 OR regexp_matches(w, '^[0-9]+$')) AS ws, list_distinct(regexp_extract_all(lower(evidence), '[a-z0-9]{3,}')) AS v,
          list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]{3,}')) AS t FROM e),
    h AS (SELECT *, list_filter(ws, lambda w: len(list_filter(v, lambda x: x = w OR (length(w) > 5 AND left(x, length(w) - 1) = left(w, length(w) - 1)))) > 0) AS held FROM k)
    SELECT evidence_id, problem, len(ws) AS words, len(held) AS held, len(held) = len(ws) AS supported, len(v) >= 3 AND len(list_filter(v, lambda x: NOT list_contains(t, x))) = 0 AS echo FROM h"""
#: Polarity of words (fixed values) and words that qualify a statement.
POLARITY = {"increase": 1, "increases": 1, "decrease": -1, "decreases": -1, "successfully": 1, "cannot": -1, "fails": -1, "works": 1, "available": 1, "unavailable": -1, "scales": 1, "bottleneck": -1, "supports": 1, "lacks": -1, "sustains": 1, "insufficient": -1, "stable": -1, "exceeds": 1, "below": -1}
# Words that two statements may share without speaking of one thing.
COMMON = ["the", "a", "an", "is", "are", "was", "were", "and", "or", "but", "with", "for", "to", "in", "of", "on", "system", "platform", "company", "new", "round", "cannot"]
QUALIFIERS = ["only", "limited", "partially", "sometimes", "depends", "constrained"]


def contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every problem compared with the first of its signature: unknown, qualifying, contradicting or supporting."""
    e = evidence(spark, folder, "problem_signature", "problem", "evidence_id").where("problem IS NOT NULL AND problem_signature IS NOT NULL")
    e = e.groupBy("problem_signature", "problem").agg(F.min("evidence_id").alias("evidence_id"))
    words = text.tokens_e(F.col("problem"))
    score = F.aggregate(F.transform(F.array_distinct(words), lambda w: areas.lookup(POLARITY, w, F.lit(0))), F.lit(0), lambda a, x: a + x)
    rows = e.select("problem_signature", "evidence_id", F.signum(score).cast("int").alias("sign"), F.array_except(words, F.array(*[F.lit(c) for c in COMMON])).alias("w"), F.arrays_overlap(words, F.array(*[F.lit(q) for q in QUALIFIERS])).alias("q"))
    first = rows.groupBy("problem_signature").agg(F.min_by(F.struct("sign", "w", "evidence_id"), "evidence_id").alias("f"))
    both = rows.join(first, "problem_signature").where("evidence_id <> f.evidence_id")
    kind = F.when(~F.arrays_overlap("w", "f.w"), "unknown").when(F.col("q"), "qualifying").when(F.col("sign") * F.col("f.sign") < 0, "contradicting").otherwise("supporting")
    return both.select("problem_signature", "evidence_id", kind.alias("kind"))


_POL = areas.sql_case(POLARITY, "w", "0")
CONTRADICTIONS = f"""WITH e AS (SELECT problem_signature, problem, min(evidence_id) AS evidence_id FROM canonical_evidence WHERE problem IS NOT NULL AND problem_signature IS NOT NULL GROUP BY ALL),
    k AS (SELECT problem_signature, evidence_id, list_distinct(regexp_extract_all(lower(problem), '[a-z0-9_]+')) AS ws FROM e),
    r AS (SELECT problem_signature, evidence_id, sign(coalesce(list_sum(list_transform(ws, lambda w: {_POL})), 0)) AS s, list_filter(ws, lambda w: NOT list_contains({COMMON}, w)) AS w, len(list_intersect(ws, {QUALIFIERS})) > 0 AS q FROM k),
    f AS (SELECT problem_signature, min(evidence_id) AS fid FROM r GROUP BY 1), g AS (SELECT r.*, x.s AS fs, x.w AS fw FROM r JOIN f USING (problem_signature) JOIN r x ON x.problem_signature = r.problem_signature AND x.evidence_id = fid WHERE r.evidence_id <> fid)
    SELECT problem_signature, evidence_id, CASE WHEN len(list_intersect(w, fw)) = 0 THEN 'unknown' WHEN q THEN 'qualifying' WHEN s * fs < 0 THEN 'contradicting' ELSE 'supporting' END AS kind FROM g"""


def signal_strength(spark: SparkSession, folder: str) -> DataFrame:
    """Signal type and evidence weight of a layer, with the mean stated strength beside it."""
    e = evidence(spark, folder, "layer", "evidence_strength", "problem", "evidence_type")
    placeholder = F.lower(F.trim(F.coalesce("problem", F.lit("")))).isin("", "unknown", "none", "n/a")
    kind = F.when(placeholder, "general_signal").otherwise(areas.signal(F.col("layer")))
    return e.select("layer", kind.alias("signal"), areas.layer_weight(F.col("layer"), said=F.col("evidence_type")).alias("weight"), "evidence_strength").groupBy("layer", "signal", "weight").agg(F.count("*").alias("n"), F.round(F.avg("evidence_strength"), 6).alias("stated"))


LAYER_NAME = "regexp_replace(lower(layer), '[^a-z0-9]', '', 'g')"
_SAID = "lower(coalesce(evidence_type, ''))"
SIGNAL_STRENGTH = f"""SELECT layer, CASE WHEN lower(trim(coalesce(problem, ''))) IN ('', 'unknown', 'none', 'n/a') THEN 'general_signal' ELSE {areas.sql_case(areas.SIGNALS, LAYER_NAME, "'general_signal'")} END AS signal,
    CAST(CASE WHEN {LAYER_NAME} = 'hackathon' OR contains({_SAID}, 'emerging_demand') THEN least({areas.sql_case(areas.LAYER_WEIGHTS, LAYER_NAME, "0.5")}, 0.25)
      WHEN {LAYER_NAME} = 'investment' OR contains({_SAID}, 'market validation') THEN least({areas.sql_case(areas.LAYER_WEIGHTS, LAYER_NAME, "0.5")}, 0.35) ELSE {areas.sql_case(areas.LAYER_WEIGHTS, LAYER_NAME, "0.5")} END AS DOUBLE) AS weight, count(*) AS n, round(avg(evidence_strength), 6) AS stated FROM canonical_evidence GROUP BY ALL"""


def interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Funding calls whose stated readiness range meets another call's of the same focus: per call the number of
    others, by counting instead of pairing. Ranges are numbers of 1 to 9, so a call meets n minus those that end before it
    or begin after it."""
    digits = F.transform(F.regexp_extract_all("trl", F.lit("[1-9]"), 0), lambda x: x.cast("int"))
    c = table(spark, folder, "funding_data", "id", areas.area(F.col("focus_area")).alias("area"), "trl").where("trl IS NOT NULL").select("id", "area", F.array_min(digits).alias("lo"), F.array_max(digits).alias("hi")).where("lo IS NOT NULL AND area IS NOT NULL")
    level = c.groupBy("area", "lo", "hi").agg(F.count("*").alias("n"))
    # At most 45 different ranges per area, whatever the number of calls.
    other = level.select(F.col("area").alias("area_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("n").alias("m"))
    meets = level.join(other, (F.col("area") == F.col("area_b")) & (F.col("hi") >= F.col("lo_b")) & (F.col("lo") <= F.col("hi_b"))).groupBy("area", "lo", "hi").agg((F.sum("m") - 1).alias("others"))
    return c.join(meets, ["area", "lo", "hi"]).select("id", "area", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), "others")


INTERVAL_OVERLAP = f"""WITH c AS (SELECT id, {AREA.replace("research_area", "focus_area")} AS area, list_transform(regexp_extract_all(trl, '[1-9]'), lambda x: CAST(x AS BIGINT)) AS d FROM funding_data WHERE trl IS NOT NULL),
    r AS (SELECT id, area, list_min(d) AS lo, list_max(d) AS hi FROM c WHERE len(d) > 0 AND area IS NOT NULL)
    SELECT a.id, a.area, a.lo, a.hi, count(*) - 1 AS others FROM r a JOIN r b ON a.area = b.area AND a.hi >= b.lo AND a.lo <= b.hi GROUP BY ALL"""


def asof_events(spark: SparkSession, folder: str) -> DataFrame:
    """As-of join, by union and a window: each error event with the user's last earlier click."""
    from pyspark.sql import Window

    e = table(spark, folder, "events", "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").where("event_type IN ('error', 'click')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "error", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "click", F.struct("ts", "event_id")), ignorenulls=True).over(w)
    out = e.withColumn("c", last).where("event_type = 'error'")
    return out.select("event_id", "user_id", F.col("c.event_id").alias("click_id"), (F.unix_micros("ts") - F.unix_micros("c.ts")).alias("gap_us"))


ASOF_EVENTS = """WITH k AS (SELECT ts, user_id, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ts, user_id), e AS (SELECT * FROM events WHERE event_type = 'error')
    SELECT e.event_id, e.user_id, k.event_id AS click_id, date_diff('microsecond', k.ts, e.ts) AS gap_us FROM e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.ts >= k.ts"""


def near_events(spark: SparkSession, folder: str) -> DataFrame:
    """Range join: purchases of a user within ten minutes after a view, in bins of ten minutes so that the band is an equality."""
    e = table(spark, folder, "events", "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    size = 600_000_000
    v = e.where("event_type = 'view'").select("user_id", F.unix_micros("ts").alias("tv"), F.explode(F.array(F.floor(F.unix_micros("ts") / size), F.floor(F.unix_micros("ts") / size) + 1)).alias("bin"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id"), F.unix_micros("ts").alias("tp"), F.floor(F.unix_micros("ts") / size).alias("bin"))
    return p.join(v, ["user_id", "bin"]).where((F.col("tp") > F.col("tv")) & (F.col("tp") - F.col("tv") <= size)).groupBy("event_id", "user_id").agg(F.count("*").alias("views"))


NEAR_EVENTS = """SELECT p.event_id, p.user_id, count(*) AS views FROM events p JOIN events v ON p.user_id = v.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 10 MINUTE
    WHERE p.event_type = 'purchase' AND v.event_type = 'view' GROUP BY 1, 2"""
QUERIES = {
    "area_rank": (area_rank, AREA_RANK), "tag_decisions": (tag_decisions, TAG_DECISIONS), "quality_gate": (quality_gate, QUALITY_GATE), "claim_support": (claim_support, CLAIM_SUPPORT),
    "contradictions": (contradictions, CONTRADICTIONS), "signal_strength": (signal_strength, SIGNAL_STRENGTH), "interval_overlap": (interval_overlap, INTERVAL_OVERLAP), "asof_events": (asof_events, ASOF_EVENTS), "near_events": (near_events, NEAR_EVENTS),
}
