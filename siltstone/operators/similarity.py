"""Set-similarity joins, token and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session
from siltstone.operators import stripes

#: Queries that a search sends to the workers at once.
QUERY_BLOCK = 2_000
#: Different elements of sets that are sent to the workers at most; more are joined. Words of 64 bits in a signature.
SENT, WORDS = 200_000, 4
#: Characters of the elements that are sent at most. Pairs of sets that cost as much in stripes as a candidate of the join. Pairs of
#: a partition of stripes.
CHARACTERS, CHEAP, PART_PAIRS = 8_000_000, 100, 5_000_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body names it often (within lambdas it would be computed each time)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, words: int = 5) -> Column:
    """Hashes of the runs of so many words of a text, distinct; a shorter text is one run."""

    def runs(tokens: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(tokens) - words), lambda i: F.xxhash64(F.slice(tokens, i + 1, words)))
        return F.when(F.size(tokens) >= words, F.array_distinct(run)).when(F.size(tokens) > 0, F.array(F.xxhash64(tokens))).otherwise(F.array().cast("array<bigint>"))

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0), runs)


def _order(sets: DataFrame, block: list[str]) -> DataFrame:
    """(block, e, df, r) of the elements that several sets (id, elements) of a block have: how many, and a number by rarity. Written once."""
    flat = sets.where(F.size("elements") > 0).select(*block, F.explode("elements").alias("e"))
    counts = flat.groupBy(*block, "e").agg(F.count("*").alias("df")).where("df > 1")
    # Numbers rise along the sorted partitions, so they are the order, and no partition has to be counted.
    return session.cut(counts.orderBy("df", *block, "e").select(*block, "e", "df", F.monotonically_increasing_id().alias("r")))


def _ordered(sets: DataFrame, block: list[str], order: DataFrame | None = None) -> DataFrame:
    """(id, block, n, common, m, s0 …, k) of sets (id, elements): the size n, the elements that another set of the block has, as
    numbers in the order of their rarity, how many these are, their signature, and a number k of the set. Written once.

    A set without common elements is like no other and has no row. A signature has a bit per element, added up modulo two:
    two signatures differ in at most as many bits as the sets in elements.
    """
    keys = [F.col(c) for c in block]
    flat = sets.where(F.size("elements") > 0).select("id", *keys, F.size("elements").alias("n"), F.explode("elements").alias("e"))
    order = (_order(sets, block) if order is None else order).select(*block, "e", "r")
    ranked = flat.join(F.broadcast(order) if order.count() <= SENT else order, [*block, "e"])
    bit = F.pmod(F.xxhash64("r"), F.lit(64 * WORDS)).cast("int")
    ranked = ranked.withColumns({"word": F.shiftright(bit, 6), "bit": F.call_function("shiftleft", F.lit(1).cast("bigint"), bit % 64)})
    signature = [F.coalesce(F.bit_xor(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).cast("bigint").alias(f"s{w}") for w in range(WORDS)]
    rows = ranked.groupBy("id", *block, "n").agg(F.array_sort(F.collect_list("r")).alias("common"), *signature)
    return session.cut(rows.withColumns({"m": F.size("common"), "k": F.monotonically_increasing_id()}))


def _striped(sets: DataFrame, order: DataFrame, threshold: float, block: list[str]) -> DataFrame | None:
    """(ia, ib, shared, na, nb), without some pairs below the threshold, by stripes; None where the join of prefixes is cheaper.

    It is dearer where sets are made of few different elements: their prefixes then meet as often as there are pairs, or more.
    """
    words = order.groupBy("e").agg(F.sum("df").alias("df"))
    few, long = words.agg(F.count("*"), F.sum(F.length(F.col("e").cast("string")))).first()
    if few > SENT or (long or 0) > CHARACTERS:
        return None
    keys = block or ["_all"]
    words = words.orderBy("df", "e").select("e").toArrow().column(0).combine_chunks()
    rows = session.cut(stripes.numbered(sets if block else sets.withColumn("_all", F.lit(0)), words, keys).withColumn("k", F.monotonically_increasing_id()))
    g = F.greatest(F.ceil(F.col("rows") / stripes.STRIPE), F.least(F.lit(4), F.ceil(F.col("rows") / 2_048))).cast("int")
    blocks = session.cut(rows.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("g", g))
    groups, pairs = blocks.agg(F.sum(F.expr("g * (g + 1) div 2")), F.sum(F.expr("rows * (rows - 1.0D) / 2"))).first()
    within = lambda share: F.greatest(F.size("common") - F.ceil(share * F.col("n") - 1e-9).cast("int") + 1, F.lit(0))
    prefix = lambda share, n: rows.select(*keys, F.explode(F.slice("common", F.lit(1), within(share))).alias("e")).groupBy(*keys, "e").agg(F.count("*").alias(n))
    met = prefix(threshold, "x").join(prefix(2 * threshold / (1 + threshold), "y"), [*keys, "e"]).agg(F.sum(F.expr("x * y * 0.5D"))).first()[0]
    if not pairs or (met or 0) * CHEAP < pairs:
        return None
    # Thrice as many partitions as groups, so that few large groups fall into one; small groups share them.
    parts = min(3 * groups, max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(pairs / PART_PAIRS)), 2_000)
    return stripes.overlaps(rows, blocks.drop("rows"), threshold, keys, parts)


def _candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(ka, kb), some repeated: the pairs of sets of _ordered() that the filters of jaccard_pairs() leave."""
    n, both = F.col("n"), 2 * threshold / (1 + threshold)

    def prefix(x: str, share: float) -> DataFrame:
        within = F.greatest(F.col("m") - F.ceil(share * n - 1e-9).cast("int") + 1, F.lit(0))
        names = {c: f"{c}{x}" for c in ("k", "n", "m", *[f"s{w}" for w in range(WORDS)])}
        return rows.select(*[F.col(c).alias(to) for c, to in names.items()], F.posexplode(F.slice("common", F.lit(1), within)).alias(f"p{x}", "e"))

    need = F.ceil(both / 2 * (F.col("na") + F.col("nb")) - 1e-9)
    smaller = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("kb") < F.col("ka")))
    differ = sum((F.bit_count(F.col(f"s{w}a").bitwiseXOR(F.col(f"s{w}b"))) for w in range(1, WORDS)), F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))))
    pairs = prefix("a", threshold).join(prefix("b", both), "e").where(smaller & (F.col("nb") >= threshold * F.col("na") - 1e-9) & (differ <= F.col("ma") + F.col("mb") - 2 * need) & (F.least(F.col("ma") - F.col("pa"), F.col("mb") - F.col("pb")) >= need))
    return pairs.select("ka", "kb")


def jaccard_pairs(sets: DataFrame, threshold: float, block: list[str] | None = None) -> DataFrame:
    """(a, b, shared, na, nb) of the rows a < b of sets (id, elements) whose Jaccard similarity reaches threshold, exactly.

    Elements are ordered by rarity. Of two sets of similarity t, the larger has a shared element among its n - ceil(t n) + 1
    rarest and the smaller among its n - ceil(2 t n / (1 + t)) + 1 rarest (prefix filter), their sizes differ by at most the
    factor t, the ranks of the shared element bound what they can still share (positional filter), and their signatures what
    they share at most. All this is asked where the two meet, so only pairs that pass are moved, once, and verified. The
    ids of sets must be distinct and stand for distinct sets (copies are collapsed before), so that a hot group of copies is
    one row here. block: columns that the two rows must share.
    """
    order = _order(sets, block or [])
    found = _striped(sets, order, threshold, block or [])
    if found is None:
        rows = _ordered(sets, block or [], order)
        pairs = _candidates(rows, threshold).distinct()
        c, d = (rows.select(F.col("k").alias(f"k{x}"), F.col("id").alias(f"i{x}"), F.col("common").alias(f"e{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        found = pairs.join(c, "ka").join(d, "kb").withColumn("shared", F.size(F.array_intersect("ea", "eb")))
    found = found.where(F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9)
    turned = F.col("ib") < F.col("ia")
    side = lambda x, y: (F.when(turned, F.col(y)).otherwise(F.col(x)), F.when(turned, F.col(x)).otherwise(F.col(y)))
    (a, b), (na, nb) = side("ia", "ib"), side("na", "nb")
    return found.select(a.alias("a"), b.alias("b"), "shared", na.alias("na"), nb.alias("nb"))


def pair_cosine(shared: Column, na: Column, nb: Column) -> Column:
    """V2: TF-IDF cosine of two token sets as a corpus of two, in closed form: a token of both weighs 1, of one ln(3/2) + 1."""
    k2 = (float(np.log(1.5)) + 1) ** 2
    return shared / F.sqrt((shared + (na - shared) * k2) * (shared + (nb - shared) * k2))


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The query rows, in blocks."""
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(n):
        yield queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == b).collect()


def token_search(queries: DataFrame, rows: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(qid, id, shared, similarity): for each query (qid, block, tokens) the k rows (id, block, tokens) of its block of
    highest Jaccard similarity (smallest id first on a tie), without itself, that share at least so many tokens.

    A stated query set is searched in blocks: each block is an inverted index on the workers, rows stream past it, and
    partial best lists are merged by query.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("shared", T.LongType()), T.StructField("similarity", T.DoubleType())])
    parts = None
    for held in _blocks(queries.select("qid", "block", "tokens")):
        index: dict = {}
        for i, q in enumerate(held):
            for t in q.tokens or ():
                index.setdefault((q.block, t), []).append(i)
        sent = spark.sparkContext.broadcast((index, [q.qid for q in held], np.array([len(q.tokens or ()) for q in held])))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index, ids, sizes = sent.value
            best: dict[int, list] = {}
            for f in batches:
                for rid, block, tokens in zip(f["id"], f["block"], f["tokens"]):
                    hits = [p for t in (tokens if tokens is not None else ()) if (p := index.get((block, t)))]
                    if not hits:
                        continue
                    shared = np.bincount(np.concatenate(hits), minlength=len(ids))
                    for q in np.flatnonzero(shared >= least):
                        if ids[q] == rid:
                            continue
                        s = int(shared[q])
                        entry = (-s / (sizes[q] + len(tokens) - s), rid, s)
                        own = best.setdefault(q, [])
                        if len(own) < k or entry < own[-1]:
                            own.append(entry)
                            own.sort()
                            del own[k:]
            out = [(ids[q], rid, s, -x) for q, own in best.items() for x, rid, s in own]
            if out:
                yield pd.DataFrame(out, columns=schema.names)

        one = session.spread(rows.select("id", "block", "tokens")).mapInPandas(run, schema)
        parts = one if parts is None else parts.unionByName(one)
    return top_k(parts, "qid", k, -F.col("similarity"), F.col("id"))


def top_k(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The k first rows of each key by order, with rank."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(qid, id, cosine, rank): V5, for each query (qid, vector) the k rows (id, vector) of largest cosine, without itself.

    Exact: a block of queries is one matrix on the workers, each batch of rows one product with it. Cosines are rounded to
    six places before any row is dropped, and the smallest id comes first on a tie, in a batch as in the whole: the result
    depends neither on batches nor on the order of rows. A null or zero vector has no neighbours.
    """
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("cosine", T.DoubleType())])

    def unit(vectors) -> np.ndarray:
        m = np.array([np.asarray(v, np.float64) for v in vectors])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)

    parts = None
    for held in _blocks(queries.where(F.col("vector").isNotNull()).select("qid", "vector")):
        if not held:
            continue
        sent = spark.sparkContext.broadcast((np.array([q.qid for q in held]), unit([q.vector for q in held])))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            for f in batches:
                f = f[f["vector"].notna()]
                if not len(f):
                    continue
                f = f.iloc[np.argsort(f["id"].to_numpy(), kind="stable")]
                own = f["id"].to_numpy()
                cosine = np.nan_to_num(matrix @ unit(f["vector"]).T, nan=-2.0)
                cosine = np.trunc(cosine * 1e6 + np.copysign(0.5, cosine)) / 1e6  # halves go away from zero, as in SQL
                cosine[ids[:, None] == own[None, :]] = -2.0
                top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]  # by id on a tie, as the rows are in order of ids
                out = pd.DataFrame({"qid": np.repeat(ids, top.shape[1]), "id": own[top.ravel()], "cosine": np.take_along_axis(cosine, top, 1).ravel()})
                yield out[out["cosine"] > -1.5]

        one = session.spread(rows.select("id", "vector")).mapInPandas(run, schema)
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        parts = spark.createDataFrame([], schema)
    return top_k(parts, "qid", k, -F.col("cosine"), F.col("id"))
