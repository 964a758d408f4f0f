"""Encoding of a corpus with a byte-level BPE vocabulary.

Method: the words (pre-tokens) that are frequent over the whole corpus are compiled, with their ids, into a minimal
acyclic automaton whose states share suffixes; the number of final states below each arc turns a walk into the word's
index, and the index gives the ids. The automaton is a few flat arrays in one file of the shared folder, which every
worker maps into memory. Words that it does not hold are merged exactly by the vocabulary's ranks.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
every document is one row, repeated texts too; a text of one very long word is merged with a heap, not quadratically.
"""

from __future__ import annotations

import base64
import heapq
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import session
from siltstone.sources.tables import table

#: Where the vocabulary files lie; every node has them there.
TOKENIZERS = os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")
#: The pattern that splits text into words before the merges (a fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in the automaton, at most, and the occurrences that a word needs: a size of the cache, not of the result.
LEXICON_WORDS = 65_536
LEXICON_COUNT = 3
LEXICON_BYTES = 64
#: Words a worker remembers beside the automaton.
MEMO_WORDS = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank (leftmost first) is merged until none is left."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or part[i] + part[j] != joined:
            continue
        part[i], alive[j], after[i] = joined, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, part[a] + part[b]))
    return [ranks[p] for p, ok in zip(part, alive) if ok]


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """One file image of the minimal automaton of the sorted distinct words, and of the ids of each, in word order.

    Built incrementally: when the next word leaves a path, the path's states are final and each is replaced by an equal
    state that exists already (same finality, same arcs), which shares suffixes and keeps the automaton minimal.
    """
    register: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []
    finals: list[bool] = []
    below: list[int] = []

    def freeze(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            finals.append(key[0])
            below.append(int(key[0]) + sum(below[t] for _, t in key[1]))
        return register[key]

    path: list[list] = [[False, []]]  # [final, [(byte, state)]], the last arc of each still open
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(labels) > depth:
            state, label = freeze(path.pop()), labels.pop()
            path[-1][1].append((label, state))

    previous = b""
    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        close(common)
        for byte in word[common:]:
            labels.append(byte)
            path.append([False, []])
        path[-1][0] = True
        previous = word
    close(0)
    root = freeze(path[0])
    first = np.zeros(len(arcs) + 1, np.int32)
    first[1:] = np.cumsum([len(a) for a in arcs])
    flat = [arc for state in arcs for arc in state]
    skip = [0] * len(flat)  # words that sort before those of an arc, within its state
    for state, own in enumerate(arcs):
        seen = int(finals[state])
        for k, (_, target) in enumerate(own):
            skip[first[state] + k] = seen
            seen += below[target]
    starts = np.zeros(len(ids) + 1, np.int32)
    starts[1:] = np.cumsum([len(x) for x in ids])
    blocks = (
        np.array([root, len(arcs), len(flat), len(ids), int(starts[-1])], np.int32), first, np.array([t for _, t in flat], np.int32),
        np.array(skip, np.int32), starts, np.array([i for x in ids for i in x], np.int32),
        np.array(finals, np.uint8), np.array([b for b, _ in flat], np.uint8),
    )
    return b"".join(b.tobytes() for b in blocks)


class Lexicon:
    """The mapped automaton of compile_lexicon."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        root, states, arcs, words, ids = (int(x) for x in raw[:20].view(np.int32))
        at = 20

        def block(n: int, kind: type) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            at += size
            return raw[at - size : at].view(kind)

        self.root, self.first, self.target, self.skip = root, block(states + 1, np.int32), block(arcs, np.int32), block(arcs, np.int32)
        self.starts, self.ids = block(words + 1, np.int32), block(ids, np.int32)
        self.final, self.label = block(states, np.uint8), block(arcs, np.uint8)

    def get(self, word: bytes) -> list[int] | None:
        """Ids of word; None if the automaton does not accept it."""
        state, index = self.root, 0
        for byte in word:
            lo, hi = int(self.first[state]), int(self.first[state + 1])
            k = lo + int(np.searchsorted(self.label[lo:hi], byte))
            if k == hi or self.label[k] != byte:
                return None
            index += int(self.skip[k])
            state = int(self.target[k])
        return self.ids[self.starts[index] : self.starts[index + 1]].tolist() if self.final[state] else None


_WORD = regex.compile(PATTERN)


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of words; the map side combines, up to a bounded number of different words at a time."""
    counts: Counter = Counter()
    for frame in batches:
        for text in frame["text"]:
            counts.update(_WORD.findall(text))
        if len(counts) > 500_000:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
            counts = Counter()
    yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})


def frequent_words(docs: DataFrame) -> list[str]:
    """The LEXICON_WORDS most frequent words of docs.text, counted over all documents."""
    counts = docs.where(F.col("text") != "").select("text").mapInPandas(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where((F.col("n") >= LEXICON_COUNT) & (F.octet_length("word") <= LEXICON_BYTES)).orderBy(F.desc("n"), "word").limit(LEXICON_WORDS)
    return [r.word for r in top.select("word").collect()]


def write_lexicon(spark: SparkSession, words: list[str], vocabulary: str) -> str:
    """Compiles words into the shared folder; returns the file's URL."""
    ranks = load_ranks(vocabulary)
    keys = sorted({w.encode() for w in words})
    image = compile_lexicon(keys, [merge(k, ranks) for k in keys])
    url = f"{session.work_dir(spark)}/lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(url)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(image))
    out.close()
    return url


def encode(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, ids) of docs (key, text)."""
    spark = docs.sparkSession
    vocabulary = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    docs = session.spread(docs.select(key, "text"))
    url = write_lexicon(spark, frequent_words(docs), vocabulary)
    spark.sparkContext.addFile(url)  # Spark brings the file to each node once, wherever the folder lies
    name = url.rsplit("/", 1)[1]
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(SparkFiles.get(name))
        ranks = load_ranks(vocabulary)
        memo: dict[str, list[int]] = {}
        for frame in batches:
            rows = []
            for text in frame["text"]:
                ids: list[int] = []
                for word in _WORD.findall(text) if text else ():
                    got = memo.get(word)
                    if got is None:
                        raw = word.encode()
                        got = lexicon.get(raw)
                        if got is None:
                            got = merge(raw, ranks)
                        if len(word) <= LEXICON_BYTES:
                            memo[word] = got
                    ids += got
                rows.append(ids)
            if len(memo) > MEMO_WORDS:
                memo.clear()
            yield pd.DataFrame({key: frame[key], "ids": rows})

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.mapInPandas(run, schema)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k, without special tokens."""
    return encode(table(spark, folder, "documents", "doc_id", "text"))


def p8_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents, characters and ids."""
    docs = table(spark, folder, "documents", "doc_id", "text", "source")
    ids = p8_ids(spark, folder).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"))
    return docs.join(ids, "doc_id").groupBy("source").agg(
        F.count("*").alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("bigint").alias("chars"), F.sum("n_ids").alias("ids")
    )
