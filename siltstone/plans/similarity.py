"""Queries of similarity joins, searches and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session
from siltstone.functions import areas, text
from siltstone.operators import graphs, similarity
from siltstone.plans.merges import evidence
from siltstone.sources.tables import table

AREA = areas.AREA_SQL
#: Similarity of near-duplicates, and of soft duplicates among evidence.
NEAR, SOFT = 0.8, 0.6
#: Similarity from which evidence of one domain and other layers corroborates.
CORROBORATING = 0.28


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by class of near-duplicates (five-word shingles, Jaccard of 0.8 or more): class id and links.

    Copies of one shingle set are one row of the join; links counts the different sets that a document's set is similar to.
    """
    docs = session.spread(table(spark, folder, "documents", "doc_id", "text")).withColumn("elements", F.array_sort(similarity.shingles(F.coalesce("text", F.lit("")))))
    key = F.struct(F.size("elements"), F.xxhash64("elements"), F.xxhash64(F.lit(5), F.col("elements")))
    docs = session.cut(docs.select("doc_id", "elements", F.when(F.size("elements") > 0, key).alias("key")))
    sets = docs.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("elements").alias("elements"))
    pairs = session.cut(similarity.jaccard_pairs(sets.select("id", "elements"), NEAR).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    classes = graphs.components(pairs)
    member = docs.select("doc_id", "key").join(sets.select("key", "id"), "key", "left")
    out = member.join(classes, "id", "left").join(links, "id", "left")
    return out.select("doc_id", F.coalesce("component", "id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_class_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes by their number of documents."""
    sizes = near_duplicates(spark, folder).groupBy("class_id").agg(F.count("*").alias("docs"))
    return sizes.groupBy("docs").agg(F.count("*").alias("classes"))


def _problems(spark: SparkSession, folder: str) -> DataFrame:
    """(id, area, elements, problem): one row per distinct token set of a problem in an area; id is its smallest evidence."""
    e = evidence(spark, folder, "evidence_id", "problem", areas.area(F.col("research_area")).alias("area")).where("problem IS NOT NULL AND area IS NOT NULL")
    e = e.withColumn("elements", F.array_sort(text.tokens_a(F.col("problem"))))
    return e.groupBy("area", "elements").agg(F.min("evidence_id").alias("id"), F.count_distinct("evidence_id").alias("records"))


def soft_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of one area by class of soft duplicates (token Jaccard of 0.6 or more): class id and links."""
    rows = session.cut(_problems(spark, folder))
    pairs = session.cut(similarity.jaccard_pairs(rows, SOFT, ["area"]).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    out = rows.join(graphs.components(pairs), "id", "left").join(links, "id", "left")
    return out.select("id", "area", "records", F.coalesce("component", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


_PROBLEMS_SQL = f"""e AS (SELECT evidence_id, {AREA} AS area, list_sort(list_distinct(regexp_extract_all(lower(problem), '[a-z0-9]{{3,}}'))) AS el FROM canonical_evidence WHERE problem IS NOT NULL),
    p AS (SELECT area, el, min(evidence_id) AS id, count(DISTINCT evidence_id) AS records FROM e WHERE area IS NOT NULL GROUP BY area, el),
    x AS (SELECT id, area, len(el) AS n, unnest(el) AS t FROM p)"""
SOFT_DUPLICATES = f"""WITH RECURSIVE {_PROBLEMS_SQL},
    s AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS sh FROM x a JOIN x b ON a.area = b.area AND a.t = b.t AND a.id < b.id GROUP BY 1, 2),
    l AS (SELECT a, b FROM s WHERE sh >= 0.6 * (na + nb - sh) - 1e-9), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    c(id, m) AS (SELECT a, a FROM u UNION SELECT u.b, c.m FROM c JOIN u ON c.id = u.a WHERE c.m < u.b), k AS (SELECT id, min(m) AS m FROM c GROUP BY id), n AS (SELECT a AS id, count(*) AS links FROM u GROUP BY a)
    SELECT p.id, p.area, records, coalesce(m, p.id) AS class_id, coalesce(links, 0) AS links FROM p LEFT JOIN k ON p.id = k.id LEFT JOIN n ON p.id = n.id"""


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of different records with one source URL and title, each with its smallest record and size."""
    e = evidence(spark, folder, "evidence_id", "source_url", F.lower(F.trim("title")).alias("t")).where("source_url <> ''").distinct()
    g = e.groupBy("source_url", "t").agg(F.min("evidence_id").alias("first"), F.count("*").alias("records"))
    return g.where("records > 1").select("source_url", "first", "records")


EXACT_DUPLICATES = "SELECT source_url, min(evidence_id) AS first, count(*) AS records FROM (SELECT DISTINCT evidence_id, source_url, lower(trim(title)) AS t FROM canonical_evidence WHERE source_url <> '') GROUP BY source_url, t HAVING count(*) > 1"
DOMAIN = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)"


def corroborating_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of problems of one area and domain on different layers with a token Jaccard of 0.28 or more, below that of
    soft duplicates.

    Records that agree in area, domain, layer and token set are one row, told by their smallest record; a pair of which
    all records have one URL and title is an exact duplicate and gives no row. The table names no actors, so the rules of
    J1 for one actor never hold. A row without problem, area or domain gives no pair; a null layer differs from any other.
    """
    e = evidence(spark, folder, "evidence_id", "problem", "layer", "source_url", F.lower(F.trim("title")).alias("t"), areas.area(F.col("research_area")).alias("area"), F.lower(F.regexp_extract("source_url", DOMAIN, 1)).alias("domain"))
    e = e.where("problem IS NOT NULL AND area IS NOT NULL AND domain <> ''").withColumn("elements", F.array_sort(text.tokens_a(F.col("problem"))))
    key = F.concat_ws("|", "area", "domain", F.coalesce(F.concat(F.lit("="), "layer"), F.lit("")), F.array_join("elements", " "))
    page = F.concat_ws("|", "source_url", F.coalesce("t", F.lit("")))
    nodes = e.withColumn("page", page).groupBy("area", "domain", "layer", "elements").agg(F.min("evidence_id").alias("record"), F.min("page").alias("low"), F.max("page").alias("high"))
    # Rows and blocks travel as hashes of fixed size.
    nodes = session.cut(nodes.withColumn("id", F.unhex(F.md5(key))).withColumn("block", F.xxhash64("area", "domain")))
    pairs = similarity.jaccard_pairs(nodes, CORROBORATING, ["block"])
    both = pairs.where(F.col("shared") < SOFT * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9)
    side = lambda x: nodes.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("area", "domain", "record", "layer", "low", "high")])
    both = both.join(side("a"), "a").join(side("b"), "b").where("area_a = area_b AND domain_a = domain_b")
    both = both.where("NOT layer_a <=> layer_b AND NOT (low_a = high_a AND low_b = high_b AND low_a = low_b)")
    return both.select(F.col("area_a").alias("area"), F.col("domain_a").alias("domain"), "record_a", "record_b", "layer_a", "layer_b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("similarity"))


CORROBORATING_EVIDENCE = rf"""WITH e AS (SELECT evidence_id, layer, {AREA} AS area, lower(regexp_extract(source_url, '{DOMAIN}', 1)) AS domain, source_url || '|' || coalesce(lower(trim(title)), '') AS page,
      list_sort(list_distinct(regexp_extract_all(lower(problem), '[a-z0-9]{{3,}}'))) AS el FROM canonical_evidence WHERE problem IS NOT NULL),
    p AS (SELECT area, domain, layer, el, min(evidence_id) AS record, min(page) AS low, max(page) AS high, md5(area || '|' || domain || '|' || coalesce('=' || layer, '') || '|' || array_to_string(el, ' ')) AS id FROM e WHERE area IS NOT NULL AND domain <> '' GROUP BY area, domain, layer, el),
    x AS (SELECT *, len(el) AS n, unnest(el) AS w FROM p),
    s AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS sh FROM x a JOIN x b ON a.area = b.area AND a.domain = b.domain AND a.w = b.w AND a.id < b.id GROUP BY 1, 2)
    SELECT a.area, a.domain, a.record AS record_a, b.record AS record_b, a.layer AS layer_a, b.layer AS layer_b, round(sh / (na + nb - sh), 6) AS similarity FROM s JOIN p a ON s.a = a.id JOIN p b ON s.b = b.id
    WHERE a.layer IS DISTINCT FROM b.layer AND sh >= 0.28 * (na + nb - sh) - 1e-9 AND sh < 0.6 * (na + nb - sh) - 1e-9 AND NOT (a.low = a.high AND b.low = b.high AND a.low = b.low)"""
_COS = "sh / sqrt((sh + (na - sh) * 1.9753313) * (sh + (nb - sh) * 1.9753313))"


def near_in_time(rows: DataFrame, keys: list[str], source: str, day: str, rec: str, days: int) -> DataFrame:
    """(a, b): links between records of one key and different sources at most so many days apart, enough of them to connect
    what all such pairs would connect, but linear in the rows.

    Rows meet in overlapping bins of days + 1, so any two within the band share one. Within a bin, in the order of days,
    rows of one source in a row form a run; each row is linked with the end of the run before and the start of the run
    after, its nearest rows of another source. By induction on the distance these links connect every qualifying pair.
    """
    size = days + 1
    one = rows.withColumn("_bin", F.explode(F.array(F.floor(F.unix_date(day) / size), F.floor(F.unix_date(day) / size) - 1)))
    by = [*keys, "_bin"]
    w = Window.partitionBy(*by).orderBy(day, source, rec)
    start = F.when(F.lag(source).over(w).eqNullSafe(F.col(source)), 0).otherwise(1)
    runs = one.withColumn("_s", start).withColumn("_run", F.sum("_s").over(w))
    ends = runs.groupBy(*by, "_run").agg(F.min(F.struct(day, rec)).alias("_first"), F.max(F.struct(day, rec)).alias("_last"))
    after = ends.select(*by, (F.col("_run") - 1).alias("_run"), F.col("_first").alias("_n"))
    before = ends.select(*by, (F.col("_run") + 1).alias("_run"), F.col("_last").alias("_n"))
    links = runs.join(after.unionByName(before), [*by, "_run"]).where(F.abs(F.datediff(F.col(f"_n.{day}"), F.col(day))) <= days)
    return links.select(F.least(rec, f"_n.{rec}").alias("a"), F.greatest(rec, f"_n.{rec}").alias("b")).where("a <> b").distinct()


def undated_links(rows: DataFrame, keys: list[str], source: str, day: str, rec: str) -> DataFrame:
    """(a, b): links that connect what all pairs of one key, different sources and a missing day would connect, linear in the rows.

    All rows of another source are linked with one undated row, its own source's undated rows with one row of another source,
    and its own source's dated rows with an undated row of another source, if there is one.
    """
    u1 = rows.where(F.col(day).isNull()).groupBy(*keys).agg(F.min(F.struct(source, rec)).alias("_u"))
    one = rows.join(u1, keys)
    own = F.col(source) == F.col(f"_u.{source}")
    x = one.where(~own).groupBy(*keys).agg(F.min(rec).alias("_x"), F.min(F.when(F.col(day).isNull(), F.col(rec))).alias("_v"))
    one = one.join(x, keys)
    to = F.when(~own, F.col(f"_u.{rec}")).when(F.col(day).isNull(), F.col("_x")).otherwise(F.col("_v"))
    return one.select(F.least(F.col(rec), to).alias("a"), F.greatest(F.col(rec), to).alias("b"), to.alias("_t")).where("_t IS NOT NULL AND a <> b").select("a", "b").distinct()


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Events retold elsewhere, by connected group: records of one area and different sources whose title and
    problem have a pair cosine of 0.82 or more, and that lie at most three days apart or of which one has no day.

    Without a resolver that judges candidates of up to 14 days, this is all that counts as retold. A cosine of 0.82 needs a
    Jaccard of 0.8 or more, so the join is exact. Dated pairs share two tokens at least, others three. A missing source is one
    of its own and has no links.
    """
    e = evidence(spark, folder, "evidence_id", "source_id", "problem", "title", areas.area(F.col("research_area")).alias("area"), F.to_date(F.coalesce(F.try_to_timestamp("published_at"), F.try_to_timestamp("retrieved_at"))).alias("day"))
    e = e.where("problem IS NOT NULL AND area IS NOT NULL AND source_id <> ''").withColumn("elements", F.array_sort(text.tokens_a(F.concat_ws(" ", "title", "problem"))))
    e = session.cut(e.select("evidence_id", "source_id", "area", "day", "elements").distinct())
    sets = session.cut(e.where(F.size("elements") > 1).groupBy("area", "elements").agg(F.min("evidence_id").alias("id")))
    pairs = similarity.jaccard_pairs(sets, NEAR, ["area"])
    cosine = similarity.pair_cosine(F.col("shared"), F.col("na"), F.col("nb"))
    near = pairs.where(cosine >= 0.82).select("a", "b", "shared").unionByName(sets.select(F.col("id").alias("a"), F.col("id").alias("b"), F.size("elements").alias("shared")))
    near = near.select(F.struct("a", "b").alias("pair"), "shared", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
    member = session.cut(e.join(sets, ["area", "elements"]).select("id", "evidence_id", "source_id", "day"))
    # Records that agree in set, source and day are told by their smallest id alone; the others are linked with it below.
    told = member.groupBy("id", "source_id", "day").agg(F.min("evidence_id").alias("rec"))
    rows = told.join(near, "id")
    edges = near_in_time(rows.where("day IS NOT NULL AND shared >= 2"), ["pair"], "source_id", "day", "rec", 3)
    edges = session.cut(edges.unionByName(undated_links(rows.where("shared >= 3"), ["pair"], "source_id", "day", "rec")))
    linked = edges.select(F.explode(F.array("a", "b")).alias("rec")).distinct()
    same = told.join(linked, "rec").withColumn("day", F.coalesce("day", F.lit("0001-01-01").cast("date"))).join(member.withColumn("day", F.coalesce("day", F.lit("0001-01-01").cast("date"))), ["id", "source_id", "day"])
    groups = graphs.components(edges.unionByName(same.where("rec <> evidence_id").select(F.col("rec").alias("a"), F.col("evidence_id").alias("b"))))
    return groups.select(F.col("id").alias("evidence_id"), F.col("component").alias("event"))


LINEAGE = f"""WITH RECURSIVE e AS (SELECT DISTINCT evidence_id, source_id, {AREA} AS area, CAST(coalesce(TRY_CAST(published_at AS TIMESTAMPTZ), TRY_CAST(retrieved_at AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS DATE) AS day,
      list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, problem)), '[a-z0-9]{{3,}}'))) AS el FROM canonical_evidence WHERE problem IS NOT NULL AND source_id <> ''),
    p AS (SELECT area, el, min(evidence_id) AS id FROM e WHERE area IS NOT NULL AND len(el) > 1 GROUP BY area, el), x AS (SELECT id, area, len(el) AS n, unnest(el) AS t FROM p),
    s AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS sh FROM x a JOIN x b ON a.area = b.area AND a.t = b.t AND a.id <= b.id GROUP BY 1, 2),
    l AS (SELECT a, b, sh FROM s WHERE {_COS} >= 0.82), m AS (SELECT p.id, e.evidence_id, e.source_id, e.day FROM e JOIN p ON e.area = p.area AND e.el = p.el),
    u AS (SELECT DISTINCT q.evidence_id AS a, r.evidence_id AS b FROM l JOIN m q ON q.id IN (l.a, l.b) JOIN m r ON r.id IN (l.a, l.b) WHERE q.source_id <> r.source_id
          AND CASE WHEN q.day IS NULL OR r.day IS NULL THEN sh >= 3 ELSE sh >= 2 AND abs(date_diff('day', q.day, r.day)) <= 3 END),
    c(id, m) AS (SELECT a, a FROM u UNION SELECT u.b, c.m FROM c JOIN u ON c.id = u.a WHERE c.m < u.b) SELECT id AS evidence_id, least(id, min(m)) AS event FROM c GROUP BY id"""


def leader_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Leader clusters of an area's problems: edges are soft duplicates, the order that of the ids."""
    return _led(session.cut(_problems(spark, folder)))


def _led(rows: DataFrame) -> DataFrame:
    """(id, leader, area, records) of rows of _problems()."""
    pairs = session.cut(similarity.jaccard_pairs(rows, SOFT, ["area"]).select("a", "b"))
    return graphs.leaders(rows, pairs).join(rows.select("id", "area", "records"), "id")


# Nodes are taken in the order of their ids; a node that no leader is linked with joins the list of leaders.
_LEADERS_SQL = f"""{_PROBLEMS_SQL},
    s AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS sh FROM x a JOIN x b ON a.area = b.area AND a.t = b.t AND a.id < b.id GROUP BY 1, 2),
    l AS (SELECT a, b FROM s WHERE sh >= 0.6 * (na + nb - sh) - 1e-9), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    o AS (SELECT p.id, row_number() OVER (ORDER BY p.id) AS r, coalesce(any_value(k.near), []) AS near FROM p LEFT JOIN (SELECT a AS id, list(b) AS near FROM u GROUP BY a) k ON p.id = k.id GROUP BY p.id),
    w(r, heads) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL SELECT o.r, CASE WHEN len(list_intersect(near, heads)) > 0 THEN heads ELSE list_append(heads, o.id) END FROM w JOIN o ON o.r = w.r + 1),
    h AS (SELECT unnest(heads) AS id FROM w WHERE r = (SELECT max(r) FROM w)),
    c AS (SELECT p.id, p.area, p.records, p.el, coalesce(h.id, (SELECT min(u.b) FROM u JOIN h g ON u.b = g.id WHERE u.a = p.id)) AS leader FROM p LEFT JOIN h ON p.id = h.id)"""
LEADER_CLUSTERS = f"WITH RECURSIVE {_LEADERS_SQL} SELECT id, area, records, leader FROM c"


def cluster_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of two or more problems with their size and commonest terms."""
    rows = session.cut(_problems(spark, folder))
    c = session.cut(_led(rows))
    terms = c.join(rows.select("id", "elements"), "id").select("leader", F.explode("elements").alias("term")).where(F.length("term") > 3).groupBy("leader", "term").agg(F.count("*").alias("n"))
    top = similarity.top_k(terms, "leader", 5, F.desc("n"), F.col("term")).groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ",").alias("terms"))
    size = c.groupBy("leader", "area").agg(F.count("*").alias("members"), F.sum("records").alias("records")).where("members > 1")
    return size.join(top, "leader")


CLUSTER_TERMS = f"""WITH RECURSIVE {_LEADERS_SQL}, t AS (SELECT leader, unnest(el) AS term FROM c), f AS (SELECT leader, term, count(*) AS n FROM t WHERE length(term) > 3 GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY n DESC, term) AS r FROM f), j AS (SELECT leader, string_agg(term, ',' ORDER BY r) AS terms FROM k WHERE r <= 5 GROUP BY leader)
    SELECT leader, area, count(*) AS members, CAST(sum(records) AS BIGINT) AS records, any_value(terms) AS terms FROM c JOIN j USING (leader) GROUP BY leader, area HAVING count(*) > 1"""


def jaccard_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different documents of one language whose token sets have a Jaccard of 0.6 or more, told by the
    smallest document of each set, and how many documents have the sets."""
    d = session.spread(table(spark, folder, "documents", "doc_id", "lang", F.array_sort(text.tokens_a(F.col("text"))).alias("elements"))).where("lang IS NOT NULL AND size(elements) > 0")
    sets = session.cut(d.groupBy("lang", "elements").agg(F.min("doc_id").alias("id"), F.count("*").alias("docs")))
    # How many documents have a set goes along with its id: there may be many pairs, and a join would move them all.
    pairs = similarity.jaccard_pairs(sets.select(F.struct("id", "docs").alias("id"), "lang", "elements"), SOFT, ["lang"])
    return pairs.select("a.id", "b.id", "a.docs", "b.docs", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6)).toDF("a", "b", "docs_a", "docs_b", "similarity")


JACCARD_DOCUMENTS = """WITH d AS (SELECT doc_id, lang, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS el FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT lang, el, min(doc_id) AS id, count(*) AS docs FROM d WHERE len(el) > 0 GROUP BY lang, el), x AS (SELECT id, lang, docs, len(el) AS n, unnest(el) AS t FROM p),
    s AS (SELECT a.id AS a, b.id AS b, any_value(a.docs) AS docs_a, any_value(b.docs) AS docs_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS sh FROM x a JOIN x b ON a.lang = b.lang AND a.t = b.t AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, docs_a, docs_b, round(sh / (na + nb - sh), 6) AS similarity FROM s WHERE sh >= 0.6 * (na + nb - sh) - 1e-9"""


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50, exactly."""
    e = table(spark, folder, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.vector_search(e.where("id % 50 = 0").withColumnRenamed("id", "qid"), e, 5)


VECTOR_TOPK = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, r.vec_id AS id, round(list_cosine_similarity(q.v, r.v), 6) AS cosine FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM s) SELECT * FROM k WHERE rank <= 5"""


def novelty(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document whose id is divisible by 50: the most similar other document of its area, and novelty points."""
    d = table(spark, folder, "documents", F.col("doc_id").alias("id"), areas.area(F.col("research_area")).alias("block"), text.tokens_a(F.col("text")).alias("tokens")).where("block IS NOT NULL AND tokens IS NOT NULL")
    best = similarity.token_search(d.where("id % 50 = 0").withColumnRenamed("id", "qid"), d, 1)
    points = F.when(F.col("similarity") <= 0.1, 15).when(F.col("similarity") <= 0.2, 12).when(F.col("similarity") <= 0.35, 9).when(F.col("similarity") <= 0.5, 6).otherwise(3)
    return best.select("qid", "id", F.round("similarity", 6).alias("similarity"), points.cast("bigint").alias("points"))


NOVELTY = f"""WITH d AS (SELECT doc_id, {AREA} AS area, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS tk FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, area, len(tk) AS n, unnest(tk) AS w FROM d WHERE area IS NOT NULL),
    s AS (SELECT q.doc_id AS qid, r.doc_id AS id, count(*) / (any_value(q.n) + any_value(r.n) - count(*)) AS sim FROM t q JOIN t r ON q.area = r.area AND q.w = r.w AND q.doc_id <> r.doc_id WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS r FROM s)
    SELECT qid, id, round(sim, 6) AS similarity, CAST(CASE WHEN sim <= 0.1 THEN 15 WHEN sim <= 0.2 THEN 12 WHEN sim <= 0.35 THEN 9 WHEN sim <= 0.5 THEN 6 ELSE 3 END AS BIGINT) AS points FROM k WHERE r = 1"""


def overlap_search(spark: SparkSession, folder: str) -> DataFrame:
    """For each evaluation item the three documents that share most of its tokens, at least three."""
    d = table(spark, folder, "documents", F.col("doc_id").alias("id"), text.tokens_a(F.col("text")).alias("tokens")).where("tokens IS NOT NULL").withColumn("block", F.lit(0))
    q = table(spark, folder, "eval_items", F.col("item_id").alias("qid"), text.tokens_a(F.col("item_text")).alias("tokens")).withColumn("block", F.lit(0))
    # Items and documents are different things: an equal id is no self-match.
    d = d.withColumn("id", F.concat(F.lit("d"), F.col("id")))
    out = similarity.token_search(q, d, 3, 3)
    return out.select("qid", F.expr("CAST(substring(id, 2) AS BIGINT)").alias("doc_id"), "shared", F.round("similarity", 6).alias("similarity"), "rank")


OVERLAP_SEARCH = """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS tk FROM documents WHERE text IS NOT NULL), q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(item_text), '[a-z0-9]{3,}')) AS tk FROM eval_items),
    dt AS (SELECT doc_id, len(tk) AS n, unnest(tk) AS w FROM d), qt AS (SELECT item_id, len(tk) AS n, unnest(tk) AS w FROM q),
    s AS (SELECT item_id AS qid, doc_id, count(*) AS shared, count(*) / (any_value(qt.n) + any_value(dt.n) - count(*)) AS sim FROM qt JOIN dt USING (w) GROUP BY 1, 2 HAVING count(*) >= 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, 'd' || doc_id) AS rank FROM s) SELECT qid, doc_id, shared, round(sim, 6) AS similarity, rank FROM k WHERE rank <= 3"""


def tfidf_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The three terms of each document of highest tf·ln(N/df)."""
    d = table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL")
    n = d.count()
    terms = d.select("doc_id", F.explode(text.tokens_e(F.col("text"))).alias("term")).where(F.length("term") > 2).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    scored = terms.join(df, "term").withColumn("weight", F.round(F.col("tf") * F.log(F.lit(float(max(n, 1))) / F.col("df")), 6))
    return similarity.top_k(scored, "doc_id", 3, F.desc("weight"), F.col("term")).select("doc_id", "term", "weight", "rank")


TFIDF_TERMS = """WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM d),
    f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) > 2 GROUP BY ALL), g AS (SELECT term, count(*) AS df FROM f GROUP BY term), n AS (SELECT greatest(count(*), 1) AS n FROM d),
    s AS (SELECT doc_id, f.term, round(tf * ln(CAST(n AS DOUBLE) / df), 6) AS weight FROM f JOIN g ON f.term = g.term CROSS JOIN n), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM s)
    SELECT * FROM k WHERE rank <= 3"""
NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
    s AS (SELECT doc_id, list_sort(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS el FROM w),
    g AS (SELECT el, min(doc_id) AS id FROM s WHERE len(el) > 0 GROUP BY el), x AS (SELECT id, len(el) AS n, unnest(el) AS t FROM g),
    p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS sh FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2), l AS (SELECT a, b FROM p WHERE sh >= 0.8 * (na + nb - sh) - 1e-9),
    u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), c(id, m) AS (SELECT a, a FROM u UNION SELECT u.b, c.m FROM c JOIN u ON c.id = u.a WHERE c.m < u.b), k AS (SELECT id, min(m) AS m FROM c GROUP BY id), n AS (SELECT a AS id, count(*) AS links FROM u GROUP BY a)
    SELECT s.doc_id, coalesce(k.m, g.id, s.doc_id) AS class_id, coalesce(n.links, 0) AS links FROM s LEFT JOIN g ON s.el = g.el AND len(s.el) > 0 LEFT JOIN k ON g.id = k.id LEFT JOIN n ON g.id = n.id"""
QUERIES = {
    "near_duplicates": (near_duplicates, NEAR_DUPLICATES), "near_class_sizes": (near_class_sizes, f"SELECT docs, count(*) AS classes FROM (SELECT class_id, count(*) AS docs FROM ({NEAR_DUPLICATES}) GROUP BY 1) GROUP BY 1"),
    "soft_duplicates": (soft_duplicates, SOFT_DUPLICATES), "exact_duplicates": (exact_duplicates, EXACT_DUPLICATES), "corroborating_evidence": (corroborating_evidence, CORROBORATING_EVIDENCE), "lineage": (lineage, LINEAGE), "leader_clusters": (leader_clusters, LEADER_CLUSTERS), "cluster_terms": (cluster_terms, CLUSTER_TERMS), "jaccard_documents": (jaccard_documents, JACCARD_DOCUMENTS),
    "vector_topk": (vector_topk, VECTOR_TOPK), "novelty": (novelty, NOVELTY), "overlap_search": (overlap_search, OVERLAP_SEARCH), "tfidf_terms": (tfidf_terms, TFIDF_TERMS),
}
