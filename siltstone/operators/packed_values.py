"""Several values packed in one text, split into one row per value with its position.

Method: known whole values (those that lists with explicit bounds, such as JSON arrays and quoted entries, carry over
the whole corpus) are put into one multi-pattern automaton; it finds them in a text, and dynamic programming picks the
cover of the text that keeps most of them whole, so that a delimiter inside a legitimate value does not split it. Text
between quotes, in round brackets and inside a number is never split.

Defined results: null, blank, ``[]``, ``-``, ``Unknown`` and ``n/a`` give no row; repeats within a value are kept, each
with its position; an unclosed bracket or quote protects nothing; very long texts are handled in one pass.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session
from siltstone.sources.tables import table

FIELDS = (("company_data", "keywords"), ("expert_data", "expertise_themes"), ("hackathon_data", "required_technology"))
#: Rows in which a value must stand whole before it protects the delimiters in it.
SUPPORT = 3
#: Characters of known values up to which the automaton is sent to the workers; a larger dictionary is joined instead.
AUTOMATON_CHARS = 8_000_000

_NOTHING = {"", "[]", "-", "–", "—", "unknown", "n/a", "none", "null"}
_DELIMITERS = ",;|·•\t\n\r"
_BULLET = re.compile(r"^(?:[•‣▪*·–-]\s+|\(?\d{1,3}[.)]\s+)")
_NUMBERED = re.compile(r"(?:^|(?<=\s))\(?\d{1,3}[.)]\s+")
_AND = re.compile(r"^(?:and|&)\s+", re.IGNORECASE)
_CLOSING = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»"}


def _listed(text: str) -> list[str] | None:
    """Items of a JSON array or a Python list; None if text is neither."""
    if not (text.startswith("[") and text.endswith("]")):
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            got = read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(got, list):
            return [str(x).strip() for x in got if x is not None]
    return None


def _quote_end(text: str, start: int) -> int:
    """Index of the mark that closes the quote opened at start, or -1: it must stand before a delimiter or the end."""
    mark, close, i = text[start], _CLOSING[text[start]], start + 1
    while (i := text.find(close, i)) >= 0:
        if text[i - 1] == "\\":
            i += 1
        elif mark == close == '"' and text[i + 1 : i + 2] == '"':
            i += 2
        else:
            rest = text[i + 1 :].lstrip(" ")
            if not rest or rest[0] in _DELIMITERS or rest.startswith("/ ") or rest[0] in "]":
                return i
            i += 1
    return -1


def segments(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, quoted) of the pieces between the delimiters of text."""
    out, start, i, quoted, fresh, n = [], 0, 0, False, True, len(text)
    while i < n:
        c = text[i]
        if fresh and c in _CLOSING and (end := _quote_end(text, i)) > 0:
            quoted, fresh, i = True, False, end + 1
            continue
        if c == "(" and (end := _bracket_end(text, i)) > 0:
            fresh, i = False, end + 1
            continue
        number = c == "," and 0 < i < n - 1 and text[i - 1].isdigit() and text[i + 1].isdigit()
        slash = c == "/" and 0 < i < n - 1 and text[i - 1].isspace() and text[i + 1].isspace()
        if (c in _DELIMITERS and not number) or slash:
            out.append((start, i, quoted))
            start, quoted, fresh = i + 1, False, True
        elif not c.isspace():
            fresh = fresh and "and".startswith(text[start : i + 1].strip().lower())  # a quote may follow this word
        i += 1
    out.append((start, n, quoted))
    return out


def _bracket_end(text: str, start: int) -> int:
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
        if text[i] == "\n":
            break
    return -1


def _clean(piece: str, first: bool) -> str:
    piece = _BULLET.sub("", piece.strip()).strip()
    if not first:
        piece = _AND.sub("", piece)
    if len(piece) > 1 and piece[0] in _CLOSING and piece[-1] == _CLOSING[piece[0]] and _quote_end(piece, 0) == len(piece) - 1:
        piece = piece[1:-1].replace('""', '"')
    return re.sub(r"\\(['\"\\])", r"\1", piece).strip()


def _edges(spans: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """The spans without the blanks at their ends."""
    return [(a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip())) for a, b in spans]


def cover(parts: list[tuple[int, int, bool]], text: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int]]:
    """Spans of the best cover of the pieces: known values over several pieces stay whole, by dynamic programming."""
    spans = [(a, b) for a, b, _ in parts]
    if automaton is None or len(parts) < 2:
        return spans
    edges = _edges(spans, text)
    first, last = {a: k for k, (a, _) in enumerate(edges)}, {b: k for k, (_, b) in enumerate(edges)}
    whole: dict[int, list[int]] = {}
    for end, size in automaton.iter(text.lower()):
        a, b = first.get(end + 1 - size), last.get(end + 1)
        if a is not None and b is not None and a < b:
            whole.setdefault(b, []).append(a)
    if not whole:
        return spans
    best, back = [0] * (len(parts) + 1), [0] * (len(parts) + 1)
    for k in range(len(parts)):  # best[k + 1]: pieces that stay within known values, over the first k + 1 pieces
        best[k + 1], back[k + 1] = best[k], k
        for a in whole.get(k, ()):
            if best[a] + k + 1 - a > best[k + 1]:
                best[k + 1], back[k + 1] = best[a] + k + 1 - a, a
    out, k = [], len(parts)
    while k:
        out.append((spans[back[k]][0], spans[k - 1][1]))
        k = back[k]
    return out[::-1]


def split(value: str | None, automaton: ahocorasick.Automaton | None = None) -> list[str]:
    """The values packed in value, in order."""
    text = (value or "").strip()
    if text.lower() in _NOTHING:
        return []
    if (items := _listed(text)) is not None:
        return [x for x in items if x]
    if _NUMBERED.match(text) and "\n" not in text and len(_NUMBERED.findall(text)) > 1:
        pieces = [p.strip().rstrip(",;") for p in _NUMBERED.split(text)]
    else:
        pieces = [text[a:b] for a, b in cover(segments(text), text, automaton)]
    out: list[str] = []
    for piece in pieces:
        if item := _clean(piece, not out):
            out.append(item)
    return out


def whole_values(value: str | None) -> list[str]:
    """Values of explicit bounds (list literals, quoted entries) that hold a delimiter."""
    text = (value or "").strip()
    items = _listed(text)
    if items is None:
        items = [_clean(text[a:b], a == 0) for a, b, quoted in segments(text) if quoted]
    return [x for x in items if len(segments(x)) > 1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _whole(values: pd.Series) -> pd.Series:
    return values.map(whole_values)


def dictionary(rows: DataFrame) -> DataFrame:
    """(known): values with a delimiter inside that stand whole in SUPPORT rows or more, over all rows."""
    known = rows.select(F.explode(_whole("value")).alias("known")).groupBy(F.lower("known").alias("known")).count()
    return known.where(F.col("count") >= SUPPORT).select("known")


def automaton_of(known: list[str]) -> ahocorasick.Automaton | None:
    """The automaton of the known values; it yields (end, length)."""
    out = ahocorasick.Automaton()
    for word in known:
        out.add_word(word, len(word))
    if not known:
        return None
    out.make_automaton()
    return out


def _joined_spans(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with the known values (column found) that stand in each, by a join: for dictionaries too large to send.

    A span of pieces is a candidate if some known value has its length, whatever its number of pieces; so the join finds
    what the automaton would. The lengths are few: their sum is at most the characters of the dictionary.
    """
    lengths = rows.sparkSession.sparkContext.broadcast(sorted(r.n for r in known.select(F.length("known").alias("n")).distinct().collect()))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes, longest = set(lengths.value), lengths.value[-1] if lengths.value else 0

        def of(value):
            text = (value or "").strip()
            low, edges, out = text.lower(), _edges([(a, b) for a, b, _ in segments(text)], text), set()
            for i, (a, _) in enumerate(edges):
                for j in range(i + 1, len(edges)):
                    if (n := edges[j][1] - a) > longest:
                        break
                    if n in sizes:
                        out.add(low[a : edges[j][1]])
            return list(out)

        for values in batches:
            yield values.map(of)

    # Values are joined, not rows: copies are searched once, and a row needs no id.
    hits = rows.select("value").where("value IS NOT NULL").distinct().select("value", F.explode(spans("value")).alias("known")).join(known, "known", "left_semi")
    hits = hits.groupBy("value").agg(F.collect_set("known").alias("found"))
    return rows.join(hits, "value", "left")


def explode_values(rows: DataFrame) -> DataFrame:
    """(table_name, row_id, item_pos, item_text) of rows (table_name, row_id, value)."""
    known = session.cut(dictionary(rows))
    size = known.agg(F.coalesce(F.sum(F.length("known")), F.lit(0))).first()[0]
    kind = T.ArrayType(T.StructType([T.StructField("item_pos", T.LongType()), T.StructField("item_text", T.StringType())]))
    listed = lambda v, a: [{"item_pos": i, "item_text": x} for i, x in enumerate(split(v, a), 1)]
    if size <= AUTOMATON_CHARS:
        words = rows.sparkSession.sparkContext.broadcast([r.known for r in known.collect()])

        @F.pandas_udf(kind)
        def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = automaton_of(words.value)
            for values in batches:
                yield values.map(lambda v: listed(v, automaton))

        split_up = rows.withColumn("_items", items("value"))
    else:

        @F.pandas_udf(kind)
        def items(values: pd.Series, found: pd.Series) -> pd.Series:
            return pd.Series([listed(v, automaton_of(list(f)) if f is not None else None) for v, f in zip(values, found)])

        split_up = _joined_spans(rows, known).withColumn("_items", items("value", "found"))
    return split_up.select("table_name", "row_id", F.inline("_items"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the three packed fields, with its position."""
    rows = None
    for name, field in FIELDS:
        one = table(spark, folder, name, "id", field).select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"), F.col(field).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.where(F.col("value").isNotNull())
    return explode_values(rows)
