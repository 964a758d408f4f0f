"""Texts cut off by a length limit or in mid-transfer.

Method: a self-join by prefix. The values are whole texts, finished sentences, headings and words. All values of a kind are
sorted, and beside each value with an open end (no end of a sentence, quote or bracket) lie the values that begin like it:
if it is a strict prefix of any longer value, it is one of the next value that is not open itself (``prefixes``). So every
open text is looked up four times: as a whole, by its last sentence, by its last line if that is a heading, and by its last
word if that is no word itself. A last sentence that is no whole prefix of another shows how far it goes along with its
neighbours in the order; it is cut if that is a long enough opening. An open end before a mark of omission needs no
partner. A last line that opens like no sentence (list, table, code, address, date, link, signature) has none and stays.

Defined results: null, empty and blank texts are never cut; a text that ends with a finished sentence is not cut even
if a longer copy exists; a longer value must have a letter in what it has more, so blanks and marks make no copy longer;
repeated texts are judged alike, each a row; identical values are compared once; work is that of sorting, however many
texts share a beginning.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session
from siltstone.sources.tables import table

#: Opening that a last sentence of at least so many characters must share with a finished one.
OPENINGS = (16, 8, 4)
#: Places in which a word or heading stands at least, to be known.
SHARED = 2
#: Sentences that must open with a phrase per text that ends with it, if several do.
FORMULA = 3
#: Characters from which an unfinished sentence is long.
LONG = 30
#: Characters by which texts that may be copies are found first; shorter ones are compared with beginnings of this length.
BEGIN = 64
#: Kinds of values.
WORD, HEADING, SENTENCE, TEXT, BEGINNING, TITLE = range(6)

_OMISSION = (
    r"\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{3,}|…|[\[(](?:truncated|cut|continued|more|abridged)[\])])"
    r"\s*[\[(]?(?:(?i)read more|continue reading|see more|more|weiterlesen|mehr lesen|lire la suite|leer más|seguir leyendo|truncated)?[\])]?[.…»›>→]*\s*$"
)
#: White space and invisible characters.
_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200D))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: An omission mark lies within so many last characters.
_MARK = 120
_CLOSED = r"(?:[.!?。！？][)\"'”’»\]*_]*|[”»]|\([^()]*\)|\[[^\[\]]*\])$"


def _masked(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\p{Nd}+", "0"), r"(?U)\s+", " ")


def endings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text) with body (text without trailing space and omission mark), its last line, marked and open."""
    df = docs.where(F.col("text").isNotNull()).withColumn("body", F.rtrim("text", F.lit(_SPACE)))
    tail = F.right("body", F.lit(_MARK))
    df = df.withColumn("marked", tail.rlike(_OMISSION))
    head = F.left("body", F.greatest(F.length("body") - _MARK, F.lit(0)))
    bare = F.rtrim(F.concat(head, F.regexp_replace(tail, _OMISSION, "")), F.lit(_SPACE))
    df = df.withColumn("body", F.when(F.col("marked"), bare).otherwise(F.col("body")))
    df = df.withColumn("line", F.trim(F.substring_index(F.replace("body", F.lit("\r"), F.lit("\n")), "\n", -1)))
    return df.withColumn("open", (F.col("body") != "") & ~F.col("line").rlike(_CLOSED))


def _piece(line: Column) -> Column:
    """The unfinished sentence at the end of a line."""
    return F.trim(F.regexp_extract(line, r"^(?s:.*[.!?][)\"'”’»]*\s+)?(.*)$", 1))


_SPLIT = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+|[\r\n]+")
_FINISHED = re.compile(r"[.!?][)\"'”’»]*$|”$|\)$")
#: Characters that may end a finished sentence.
_ENDS = ".!?)\"'”’»"
_NUMBER = re.compile(r"\d+")
_WORD = re.compile(r"[^\W\d_]+(?=[\W\d_])")
_HEAD = re.compile(r"#{1,6} .+")
#: Different keys that a task counts before it hands them on.
KEYS = 400_000


def core(text: str) -> str:
    """text up to its last letter."""
    end = len(text)
    while end and not text[end - 1].isalpha():
        end -= 1
    return text[:end]


def _witnesses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of the values of the corpus: words, headings as they are and up to their last letter, finished sentences."""
    counts: Counter = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"kind": [k for k, _ in counts], "v": pd.Series([k for _, k in counts], dtype=object), "n": list(counts.values())}).astype({"kind": "int32", "n": "int64"})

    for f in batches:
        for text in f["text"]:
            # A word counts where something follows it; the end of a text is no witness for its own last word.
            counts.update((WORD, w) for w in _WORD.findall(text.lower()))
            for s in _SPLIT.split(text):
                if len(s) > 24 and s[-1:] in _ENDS or s[:1] == "#" or s[-1:].isspace() or s[:1].isspace():
                    s = " ".join(s.split())
                    if len(s) > 24 and _FINISHED.search(s, len(s) - 8):
                        counts[SENTENCE, core(_NUMBER.sub("0", s))] += 1
                    elif s.startswith("#") and _HEAD.fullmatch(s):
                        counts[TITLE, s] += 1
                        counts[HEADING, core(s)] += 1
        if len(counts) > KEYS:
            yield out()
            counts.clear()
    if counts:
        yield out()


def witnesses(corpus: DataFrame) -> DataFrame:
    """(kind, v): the different finished sentences of the corpus, and the words and headings in SHARED places or more, in one pass."""
    parts = corpus.select("text").mapInPandas(_witnesses, "kind int, v string, n bigint").where("v <> ''")
    counts = parts.groupBy("kind", "v").agg(F.sum("n").alias("n")).where((F.col("n") >= SHARED) | (F.col("kind") == SENTENCE))
    return session.cut(counts.select("kind", "v"))


def shared(a: str, b: str) -> int:
    """Characters with which both begin."""
    if b.startswith(a):
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


_SCANNED = "kind int, v string, shared int, whole boolean, pid int, before boolean, after boolean, first string, last string, first_kind int, last_kind int"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one sorted partition: the open values with what they share with the answers beside them, and one row of its edges."""
    pid = TaskContext.get().partitionId()
    kind, last, older, first = None, None, None, None
    waiting: list[list] = []
    out: list[tuple] = []
    starting = True  # no answer of the first kind was met yet

    def close(following: str | None, after: bool) -> None:
        for v, common, before in waiting:
            whole = following is not None and following.startswith(v) and len(following) > len(v)
            if following is not None and kind not in (TEXT, BEGINNING):
                common = max(common, shared(v, following))
            out.append((kind, v, common, whole, pid, before, after, None, None, None, None))
        waiting.clear()

    for f in batches:
        for k, v, answer in zip(f["kind"].tolist(), f["v"].tolist(), f["answer"].tolist()):
            if k != kind:
                if kind is not None:
                    close(None, False)
                    starting = False
                kind, last, older = k, None, None
            if answer:
                close(v, False)
                first = first or (k, v)
                older, last, starting = last, v, False
            else:
                beside = older if last == v else last
                waiting.append([v, shared(v, beside) if beside is not None and k not in (TEXT, BEGINNING) else 0, starting])
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=_NAMES)
            out.clear()
    close(None, True)
    if first:
        out.append((None, None, None, None, pid, None, None, first[1], last, first[0], kind if last is not None else None))
    if out:
        yield pd.DataFrame(out, columns=_NAMES).astype({c: "Int32" for c in ("kind", "shared", "first_kind", "last_kind")})


_NAMES = [c.strip().split()[0] for c in _SCANNED.split(",")]


@F.pandas_udf(T.IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shared(x, y) if x is not None and y is not None else 0 for x, y in zip(a, b)], dtype="int32")


def prefixes(asks: DataFrame, answers: DataFrame) -> DataFrame:
    """(kind, v, shared, whole) of asks (kind, v): the characters that v shares at most with an answer of its kind, and
    whether v is a strict prefix of an answer (shared is not told for whole texts). Both sides hold distinct values.

    Values are sorted over all partitions. Those that begin with v follow it without a gap, so the next answer tells.
    Where it lies in another partition, the edges of the partitions, one row each, tell.
    """
    rows = asks.select("kind", "v", F.lit(False).alias("answer")).unionByName(answers.select("kind", "v", F.lit(True).alias("answer")))
    tasks = max(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), asks.sparkSession.sparkContext.defaultParallelism)
    # Of equal values the answer comes first, so that no value answers itself.
    rows = rows.repartitionByRange(tasks, "kind", "v").sortWithinPartitions("kind", "v", F.desc("answer"))
    seen = session.cut(rows.mapInPandas(_scan, _SCANNED))
    edges = seen.where("kind IS NULL").select("pid", "first", "last", "first_kind", "last_kind")
    open_ = seen.where("kind IS NOT NULL AND (before OR after)").select("kind", "v", "shared", "whole", "pid", "before", "after")
    # One row per partition of the sort, whatever the data: one task orders them.
    every = edges.unionByName(open_.select("pid", *[F.lit(None).cast(t).alias(c) for c, t in (("first", "string"), ("last", "string"), ("first_kind", "int"), ("last_kind", "int"))]).distinct()).groupBy("pid").agg(*[F.max(c).alias(c) for c in ("first", "last", "first_kind", "last_kind")])
    w = Window.orderBy("pid")
    ahead, behind = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    beside = every.select(
        "pid",
        F.first(F.when(F.col("first").isNotNull(), F.struct("first_kind", "first")), True).over(ahead).alias("next"),
        F.last(F.when(F.col("last").isNotNull(), F.struct("last_kind", "last")), True).over(behind).alias("prior"),
    )
    met = open_.join(beside, "pid")
    following = F.when(F.col("after") & (F.col("next.first_kind") == F.col("kind")), F.col("next.first"))
    preceding = F.when(F.col("before") & (F.col("prior.last_kind") == F.col("kind")), F.col("prior.last"))
    small = ~F.col("kind").isin(TEXT, BEGINNING)
    common = F.when(small, F.greatest("shared", _shared("v", following), _shared("v", preceding))).otherwise(F.col("shared"))
    whole = F.coalesce(F.startswith(following, F.col("v")) & (F.length(following) > F.length("v")), F.lit(False))
    met = met.select("kind", "v", common.alias("shared"), (F.col("whole") | whole).alias("whole"))
    return seen.where("kind IS NOT NULL AND NOT (before OR after)").select("kind", "v", "shared", "whole").unionByName(met)


@F.pandas_udf(T.StringType())
def _core(texts: pd.Series) -> pd.Series:
    return texts.map(core)


def _words(ends: DataFrame, seen: DataFrame) -> DataFrame:
    """(doc_id, v) of last words that are none of the corpus's words."""
    last = ends.where(~F.col("line").rlike(r"://\S*$|@\S*$|^```")).select("doc_id", F.lower(F.regexp_extract("line", r"(?:^|[\s\p{P}])(\p{L}+)$", 1)).alias("v"))
    return last.where("v <> ''").join(seen.where(F.col("kind") == WORD), "v", "left_anti")


def _headings(ends: DataFrame, seen: DataFrame) -> DataFrame:
    """(doc_id, v) of last lines that are headings which no other text has whole."""
    last = ends.where(F.col("line").rlike(r"^#{1,6}(?: .*)?$")).select("doc_id", F.col("line").alias("v"))
    return last.join(seen.where(F.col("kind") == TITLE), "v", "left_anti")


def _texts(ends: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, kind, v) of the open texts, (kind, v) of the texts that may continue them).

    Only texts that begin like an open one can continue it: one hash of BEGIN characters per text decides, and few texts go on.
    """
    kind = F.when(F.length("body") < BEGIN, F.lit(BEGINNING)).otherwise(F.lit(TEXT)).alias("kind")
    asks = ends.select("doc_id", kind, F.col("body").alias("v"))
    start = lambda c: F.xxhash64(F.left(c, F.lit(BEGIN))).alias("s")
    # The hashes are written, so that their size is known to the join; while they are few, no text is moved.
    begins = session.cut(asks.where(F.col("kind") == TEXT).select(start(F.col("v"))).distinct())
    near = docs.where(F.length("text") > BEGIN).select("text", start(F.col("text"))).join(begins, "s", "left_semi")
    long = near.select(F.lit(TEXT).alias("kind"), _core("text").alias("v"))
    short = docs.select(F.lit(BEGINNING).alias("kind"), F.regexp_replace(F.left("text", F.lit(BEGIN)), r"\P{L}+$", "").alias("v"))
    return asks, long.unionByName(short).where("v <> ''").distinct()


def _unclear(hits: DataFrame, ends: DataFrame, seen: DataFrame) -> DataFrame:
    """The openings (v, k) of hits that are closing formulas: several texts end with them (a date, an office), and not far more
    sentences open with them; copies of a text count once."""
    closing = ends.groupBy("v").agg(F.count_distinct(F.xxhash64("body")).alias("m")).where("m > 1")
    asked = hits.join(closing, "v").select("v", "m", F.col("need").alias("need"), F.substring(F.col("v"), F.lit(1), F.col("need")).alias("k"))
    openings = seen.where(F.col("kind") == SENTENCE).select(F.explode(F.array(*[F.left("v", F.lit(n)) for n in OPENINGS])).alias("k"))
    counts = openings.join(asked.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count("*").alias("n"))
    return asked.join(counts, "k", "left").where(F.coalesce("n", F.lit(0)) < FORMULA * F.col("m")).select("v")


def levels(docs: DataFrame) -> DataFrame:
    """(doc_id, level) of the documents (doc_id, source, text) that were cut: each level that shows it, one of mark, text,
    sentence (a whole prefix of a longer one), opening (a part of it is), heading and word."""
    docs = session.spread(docs.select("doc_id", "source", "text")).where(F.col("text").isNotNull())
    ends = endings(docs).where("open")
    ends = session.cut(ends.select("doc_id", "marked", "body", "line", _piece(F.col("line")).alias("piece")))
    marked, ends = ends.where("marked").select("doc_id", F.lit("mark").alias("level")), ends.where("NOT marked")
    seen = witnesses(docs)
    pieces = ends.select("doc_id", "body", _masked(F.col("piece")).alias("v")).where(F.length("v") >= OPENINGS[-1])
    asks, texts = _texts(ends, docs)
    asks = asks.unionByName(pieces.select("doc_id", F.lit(SENTENCE).alias("kind"), "v"))
    asks = asks.unionByName(_words(ends, seen).select("doc_id", F.lit(WORD).alias("kind"), "v")).unionByName(_headings(ends, seen).select("doc_id", F.lit(HEADING).alias("kind"), "v"))
    asks = session.cut(asks)
    answers = seen.where(F.col("kind").isin(WORD, HEADING, SENTENCE)).unionByName(texts)
    met = session.cut(prefixes(asks.select("kind", "v").distinct(), answers))
    # A long stretch of words without an end needs a shorter common opening than a phrase that may stand by itself.
    need = F.when(F.length("v") > LONG, F.lit(8)).otherwise(F.coalesce(*[F.when(F.length("v") >= n, F.lit(n)) for n in OPENINGS]))
    sentences = met.where(F.col("kind") == SENTENCE).withColumn("need", need).where("whole OR shared >= need")
    sentences = sentences.join(_unclear(sentences, pieces, seen), "v", "left_anti")
    level = F.when(F.col("kind") == SENTENCE, F.when(F.col("whole"), "sentence").otherwise("opening"))
    level = level.when(F.col("kind") == WORD, "word").when(F.col("kind") == HEADING, "heading").otherwise("text")
    hits = sentences.select("kind", "v", "whole").unionByName(met.where((F.col("kind") != SENTENCE) & F.col("whole")).select("kind", "v", "whole"))
    found = asks.join(hits, ["kind", "v"]).select("doc_id", level.alias("level"))
    # A first word of up to three letters after a finished sentence begins one.
    short = ends.where(F.col("piece").rlike(r"^[¿¡“«]?\p{Lu}\p{L}{0,2}$") & (F.col("piece") != F.col("line"))).select("doc_id", F.lit("opening").alias("level"))
    return found.unionByName(short).unionByName(marked).distinct()


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents (doc_id, source, text) that were cut."""
    return levels(docs).select("doc_id").distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were cut."""
    return truncated(table(spark, folder, "documents", "doc_id", "source", "text"))


#: The levels, the most certain first.
LEVELS = ("mark", "text", "sentence", "heading", "word", "opening")


def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents, cut documents, their share, the commonest length at which texts were cut, and the cut documents
    by the most certain level that shows it."""
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    cut = levels(docs).groupBy("doc_id").agg(F.min_by("level", rank).alias("level"))
    rows = docs.select("doc_id", "source", F.length("text").alias("n")).join(cut, "doc_id", "left")
    size = F.when(F.col("level").isNotNull(), F.col("n"))
    return rows.groupBy("source").agg(
        F.count("*").alias("docs"), F.count("level").alias("cut_docs"), F.round(F.count("level") / F.count("*"), 6).alias("share"), F.mode(size, True).cast("bigint").alias("usual_length"),
        *[F.count_if(F.col("level") == x).alias(f"by_{x}") for x in LEVELS],
    )
