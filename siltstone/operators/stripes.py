"""Overlaps of all pairs of sets over a small vocabulary, where a join by elements would meet most pairs many times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sets of a stripe, of the two sides of a tile within stripes, and pairs that leave a worker at once.
STRIPE, HIGH, WIDE, OUT = 16_384, 1_024, 8_192, 500_000
#: An element is a column of the matrix product where at least this share of a tile's pairs has it; others are added pair by pair.
DENSE = 1 / 300


def numbered(sets: DataFrame, words: pa.Array, block: list[str]) -> DataFrame:
    """(id, block, n, common, packed) of sets (id, elements): the size, and the numbers of those elements that are in words, in order.

    packed has a number as its distance from the one before: a byte of 255 for each 255 of it, and a byte for the rest.
    """
    sent = sets.sparkSession.sparkContext.broadcast(words)
    rows = sets.where(F.size("elements") > 0).select("id", *block, F.size("elements").alias("n"), "elements")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("common", T.ArrayType(T.IntegerType())), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            place = pc.index_in(lists.flatten(), value_set=sent.value)
            known = place.is_valid().to_numpy(zero_copy_only=False)
            row, e = pc.list_parent_indices(lists).to_numpy()[known], place.fill_null(0).to_numpy()[known]
            e = e[np.lexsort((e, row))]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
            common = pa.ListArray.from_arrays(pa.array(ends), pa.array(e, pa.int32()))
            far, starts = np.diff(e, prepend=0), ends[:-1][np.diff(ends) > 0]
            far[starts] = e[starts]
            stops = np.concatenate([[0], np.cumsum(far // 255 + 1)]).astype(np.int32)
            data = np.full(stops[-1], 255, np.uint8)
            data[stops[1:] - 1] = far % 255
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(stops[ends]), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], common, packed], [*b.schema.names[:-1], "common", "packed"])

    return rows.mapInArrow(run, schema).where(F.size("common") > 0)


def overlaps(rows: DataFrame, blocks: DataFrame, threshold: float, block: list[str], parts: int) -> DataFrame:
    """(ia, ib, shared, na, nb) of the pairs of rows of numbered(), with a number k each, that can reach the threshold, each once.

    blocks (block, g): the rows of a block fall into g stripes by hash. Any two stripes meet in one group of rows, of bounded
    size, and a worker counts what its pairs share tile by tile; only pairs that pass leave it. So a row moves g times, and
    candidates never. parts: in how many partitions the groups are met.
    """
    stripe = F.pmod(F.xxhash64("k"), F.col("g")).cast("int")
    met = rows.join(blocks, block).withColumn("s", stripe).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    met = met.select(*block, F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), (F.col("s") > F.col("o")).alias("second"), "id", "n", "packed")
    keys = [*block, "i", "j"]
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("ia", kind), T.StructField("ib", kind), *[T.StructField(c, T.IntegerType()) for c in ("shared", "na", "nb")]])
    part = threshold / (1 + threshold)  # of both sizes together, that a pair has to share
    high, wide, out, dense = HIGH, WIDE, OUT, DENSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches)).sort_by("n")

        def side(t: pa.Table) -> tuple:
            packed = t["packed"].combine_chunks()
            at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :][: len(packed) + 1]
            data = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]]
            total, last = np.concatenate([[0], np.cumsum(data, dtype=np.int64)]), data != 255
            ends = np.concatenate([[0], np.cumsum(last)])[at - at[0]]
            return t["id"].combine_chunks(), t["n"].to_numpy(), total[1:][last] - np.repeat(total[at[:-1] - at[0]], np.diff(ends)), ends

        def tile(x: tuple, low: int, top: int) -> tuple:
            """Elements of the rows, in order, the rows that have them, and where each different element begins and ends."""
            e, row = x[2][x[3][low] : x[3][top]], np.repeat(np.arange(top - low), np.diff(x[3][low : top + 1]))
            order = np.argsort(e, kind="stable")
            e, row = e[order], row[order]
            different, first = np.unique(e, return_index=True)
            return different, row, first, np.append(first[1:], len(e))

        def matrix(n: np.ndarray, t: tuple, columns: np.ndarray, sign: list[np.ndarray]) -> np.ndarray:
            """A column for each of those different elements, and two that subtract what the sizes ask for."""
            m = np.zeros((len(n), len(columns) + 2), np.float32)
            for c, k in enumerate(columns):
                m[t[1][t[2][k] : t[3][k]], c] = 1
            m[:, -2], m[:, -1] = sign
            return m

        second = both["second"].to_numpy(zero_copy_only=False)
        own = not second.any()  # a stripe and itself
        if not own and second.all():
            return
        a = side(both.filter(pa.array(~second)))
        b = a if own else side(both.filter(pa.array(second)))
        for c0 in range(0, len(b[1]), wide):
            c1 = min(c0 + wide, len(b[1]))
            tb = tile(b, c0, c1)
            for r0 in range(c0 if own else 0, len(a[1]), high):
                r1 = min(r0 + high, len(a[1]))
                na, nb = a[1][r0:r1], b[1][c0:c1]
                # Rows are in the order of sizes, so those of fitting sizes are neighbours.
                x0, x1 = np.searchsorted(nb, threshold * na[0] - 1e-9), np.searchsorted(nb, na[-1] / threshold + 1e-9, "right")
                if x0 >= x1:
                    continue
                ta = tile(a, r0, r1)
                _, ka, kb = np.intersect1d(ta[0], tb[0], assume_unique=True, return_indices=True)
                often = (ta[3] - ta[2])[ka] * (tb[3] - tb[2])[kb] >= dense * len(na) * len(nb)
                ones = np.ones(1, np.float32)
                left = matrix(na, ta, ka[often], [-part * na, ones])
                right = matrix(nb, tb, kb[often], [ones, -part * nb])[x0:x1]
                over = left @ right.T
                for i, j in zip(ka[~often], kb[~often]):
                    at = tb[1][tb[2][j] : tb[3][j]] - x0
                    over[ta[1][ta[2][i] : ta[3][i]][:, None], at[(at >= 0) & (at < x1 - x0)]] += 1
                hit = np.flatnonzero(over >= -0.01)  # rounding; the caller asks exactly
                i, j = np.divmod(hit, x1 - x0)
                shared = np.rint(over.ravel()[hit] + part * (na[i] + nb[j + x0])).astype(np.int32)
                del over
                i, j = i + r0, j + x0 + c0
                if own:
                    once = i > j
                    i, j, shared = i[once], j[once], shared[once]
                for p in range(0, len(i), out):
                    q = slice(p, p + out)
                    yield pa.RecordBatch.from_arrays([a[0].take(pa.array(i[q])), b[0].take(pa.array(j[q])), pa.array(shared[q]), pa.array(a[1][i[q]]), pa.array(b[1][j[q]])], schema.names)

    # A number given is not changed by adaptive plans, which go by bytes and not by pairs.
    return met.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, schema)
