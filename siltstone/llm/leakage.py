"""Evaluation items that leak into the documents of a corpus.

Method: a prefix-filtered set join. The items' runs of ``RUN`` words (shingles) are the sets; their words are ordered by
rarity in the corpus. As a match must hold every word of a shingle, its prefix is its single rarest word, so one word per
shingle is joined. A document's occurrence of that word is a candidate; positional bounds (the shingle's words before and
after it must fit into the document) and the ends of the window prune it; the words of the whole window decide exactly.

Words are counted once over the corpus, whatever the number of items. If the items' index is small (``INDEX_SHINGLES``, its
size is counted first), documents stream past it. If not, documents give the windows around the prefix words, and these are
joined with the shingles by prefix and ends of the window; the number of scans does not grow with the items either.

A word is a longest run of letters and digits; case, other characters between words and invisible characters are
ignored. Defined results: null, empty and short texts and items give no row; an item that stands several times in a
document gives one row; repeated items and documents are all reported; long texts are scanned in one pass.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session
from siltstone.sources.tables import table

#: Consecutive words that a text and an item must share.
RUN = 12
#: Shingles up to which the items' index is sent to the workers; more of them are joined.
INDEX_SHINGLES = 100_000
#: Different words that a task counts before it hands them on.
KEYS = 400_000

_INVISIBLE = regex.compile(r"\p{Cf}+|[͏ᅟᅠ឴឵᠋-᠍︀-️]+")
_WORD = regex.compile(r"[\p{L}\p{Nd}\p{Nl}\p{No}]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case."""
    return _WORD.findall(_INVISIBLE.sub("", text).lower()) if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(words_of)


def _vocabulary_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial document frequencies of words."""
    counts: Counter = Counter()
    out = lambda: pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})
    for frame in batches:
        for text in frame["text"]:
            counts.update(set(words_of(text)))
        if len(counts) > KEYS:
            yield out()
            counts.clear()
    yield out()


def shingles(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, prefix, offset, window) of every run of words of the items (item_id, item_text): its rarest word in docs."""
    runs = items.select("item_id", _words("item_text").alias("w")).where(F.size("w") >= RUN).distinct()
    runs = runs.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - RUN + 1), lambda i: F.slice("w", i, RUN))).alias("window"))
    runs = session.cut(runs.distinct())
    vocabulary = runs.select(F.explode("window").alias("word")).distinct()
    counts = docs.select("text").mapInPandas(_vocabulary_counts, "word string, n bigint").join(vocabulary, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    flat = runs.select("item_id", "window", F.posexplode("window").alias("offset", "word")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset"))
    return flat.groupBy("item_id", "window").agg(rarest.alias("r")).select("item_id", F.col("r.word").alias("prefix"), F.col("r.offset").alias("offset"), "window")


def index(rows: list) -> dict[str, dict]:
    """Prefix word -> {(offset, first and last word of the window): {the shingle's words: its items}}."""
    out: dict[str, dict] = {}
    for r in rows:
        shingle = tuple(map(sys.intern, r.window))
        out.setdefault(r.prefix, {}).setdefault((r.offset, shingle[0], shingle[-1]), {}).setdefault(shingle, set()).add(r.item_id)
    return out


def matches(words: list[str], prefixes: dict[str, dict], offsets: dict[str, list[int]]) -> set:
    """Items of the index that share a shingle with words."""
    found, n = set(), len(words)
    if n < RUN:
        return found
    for at, word in enumerate(words):
        if (group := prefixes.get(word)) is not None:
            for offset in offsets[word]:
                start = at - offset
                # Positional bounds, the window's ends by one lookup, then the window itself.
                if 0 <= start <= n - RUN and (ends := group.get((offset, words[start], words[start + RUN - 1]))) is not None:
                    found |= ends.get(tuple(words[start : start + RUN]), set())
    return found


def _streamed(docs: DataFrame, held: list, schema: T.StructType) -> DataFrame:
    """Documents past an index that the workers hold."""
    sent = docs.sparkSession.sparkContext.broadcast(index(held))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefixes = sent.value
        offsets = {w: sorted({o for o, _, _ in group}) for w, group in prefixes.items()}
        for frame in batches:
            rows = [(d, i) for d, text in zip(frame["doc_id"], frame["text"]) for i in sorted(matches(words_of(text), prefixes, offsets))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

    return docs.mapInPandas(run, schema)


def _joined(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The same by a join: the documents' windows around prefix words with the shingles, by a hash of prefix, offset and ends.

    Of a document only hashes of (word, offset, ends) that some shingle has are kept, by a join on the hash; the window's
    words are then compared. Copies of a text are searched once. A prefix word that many documents have is split by the ends
    of its windows, so no key is hotter than one window's text.
    """
    key = lambda w, o, a, b: F.xxhash64(w, o, a, b)
    wanted = rows.select("item_id", "window", key("prefix", "offset", F.get("window", F.lit(0)), F.get("window", F.lit(RUN - 1))).alias("k"))
    # A word's offsets are at most RUN, so a window gives at most RUN keys, and only where its word is a prefix.
    offsets = rows.groupBy(F.col("prefix").alias("word")).agg(F.collect_set("offset").alias("offsets"))
    texts = docs.where("text IS NOT NULL").groupBy("text").agg(F.xxhash64(F.first("text")).alias("t"), F.xxhash64(F.lit(5), F.first("text")).alias("u"))
    words = session.cut(texts.select("t", "u", _words("text").alias("w")).where(F.size("w") >= RUN))
    spots = words.select("t", "u", F.posexplode("w").alias("at", "word")).join(offsets, "word").select("t", "u", "at", "word", F.explode("offsets").alias("offset"))
    starts = spots.select("t", "u", "word", "offset", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
    starts = starts.groupBy("t", "u").agg(F.collect_set(F.struct("start", "word", "offset")).alias("starts"))
    windows = words.join(starts, ["t", "u"]).select("t", "u", "w", F.explode("starts").alias("s")).where(F.col("s.start") <= F.size("w") - RUN)
    windows = windows.select("t", "u", F.slice("w", F.col("s.start") + 1, RUN).alias("found"), key("s.word", "s.offset", F.get("w", F.col("s.start")), F.get("w", F.col("s.start") + RUN - 1)).alias("k"))
    hits = windows.join(wanted, "k").where(F.col("found") == F.col("window")).select("t", "u", "item_id").distinct()
    mine = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(5), F.col("text")).alias("u"))
    return mine.join(hits, ["t", "u"]).select("doc_id", "item_id")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of docs (doc_id, text) and items (item_id, item_text)."""
    docs = session.spread(docs.select("doc_id", "text").where(F.length("text") >= 2 * RUN - 1))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType)])
    rows = session.cut(shingles(items.select("item_id", "item_text").where(F.length("item_text") >= 2 * RUN - 1), docs))
    if rows.count() <= INDEX_SHINGLES:
        return _streamed(docs, rows.collect(), schema)
    return _joined(docs, rows)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with each evaluation item that it holds a run of."""
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "item_text")).distinct()


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation item: the documents that hold it; 0 for those that leaked nowhere."""
    items = table(spark, folder, "eval_items", "item_id", "suite")
    return items.join(p9_found(spark, folder), "item_id", "left").groupBy("item_id", "suite").agg(F.count("doc_id").alias("docs"))


def _grams_sql(key: str, text: str, table: str) -> str:
    words = rf"regexp_extract_all(lower(regexp_replace({text}, '[\p{{Cf}}\x{{034f}}\x{{115f}}\x{{1160}}\x{{17b4}}\x{{17b5}}\x{{180b}}-\x{{180d}}\x{{fe00}}-\x{{fe0f}}]+', '', 'g')), '[\p{{L}}\p{{N}}]+')"
    return f"SELECT {key}, unnest(list_transform(range(len(w) - {RUN - 1}), lambda k: array_to_string(w[k + 1:k + {RUN}], ' '))) AS s FROM (SELECT {key}, {words} AS w FROM {table} WHERE {text} IS NOT NULL) WHERE len(w) >= {RUN}"


P9_SQL = f"WITH d AS ({_grams_sql('doc_id', 'text', 'documents')}), i AS ({_grams_sql('item_id', 'item_text', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (s)"
P9_ITEMS_SQL = f"SELECT item_id, suite, count(doc_id) AS docs FROM eval_items LEFT JOIN ({P9_SQL}) USING (item_id) GROUP BY item_id, suite"
