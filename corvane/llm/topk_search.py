"""Exact top-k search: inner products added up in a bit-sliced index, the best rows read off slice by slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.storage import durable


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


class BitSlices:
    """Rows' attributes as slices: for each attribute and bit a bitmap over rows, in words of 64 rows.

    An attribute is held above its least value, so that all slices are of numbers from 0.
    """

    def __init__(self, ids: np.ndarray, least: np.ndarray, bits: list[int], slices: bytes | None = None):
        self.ids, self.least, self.bits, self.n = ids, least, bits, len(ids)
        self.words, self.first = -(-self.n // 64), np.cumsum([0, *bits])
        shape = (max(1, int(self.first[-1])), self.words)
        self.slices = np.zeros(shape, np.uint64) if slices is None else np.frombuffer(slices, np.uint64).reshape(shape)
        self.all = self.bitmap(np.ones(self.n))

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> BitSlices:
        """The index of these rows, in order of their ids."""
        order = np.argsort(ids, kind="stable")
        vectors = vectors[order]
        least = vectors.min(axis=0)
        above = (vectors - least).astype(np.uint64)
        index = cls(ids[order], least, [int(m).bit_length() for m in above.max(axis=0)])
        for d, n in enumerate(index.bits):
            for b in range(n):
                index.slices[index.first[d] + b] = index.bitmap((above[:, d] >> np.uint64(b)) & np.uint64(1))
        return index

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        packed = np.packbits(np.asarray(flags, bool), bitorder="little")
        return np.concatenate([packed, np.zeros(self.words * 8 - len(packed), np.uint8)]).view(np.uint64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of query · row for all rows, the lowest first, and what is to be added to their value.

        Each set bit of a weight adds its attribute's slices that many places up; under a negative weight the
        slices' complements are added and the sum set off. Bitmaps of one place are added three at a time to a
        sum and a carry until one is left.
        """
        places: list[list[int]] = []
        offset = 0
        for d, q in enumerate(query.tolist()):
            offset += q * int(self.least[d]) + (q * ((1 << self.bits[d]) - 1) if q < 0 else 0)
            for w in range(abs(q).bit_length()):
                if abs(q) >> w & 1:
                    for b in range(self.bits[d]):
                        while len(places) <= w + b:
                            places.append([])
                        at = int(self.first[d]) + b
                        places[w + b].append(at if q > 0 else -1 - at)
        total, carried, p = [], np.zeros((0, self.words), np.uint64), 0
        while p < len(places) or len(carried):
            at = np.array(places[p] if p < len(places) else [], dtype=np.int64)
            x = np.concatenate([carried, self.slices[at[at >= 0]], ~self.slices[-1 - at[at < 0]]])
            carries = []
            while len(x) > 1:
                if len(x) == 2:
                    carries.append((x[0] & x[1])[None])
                    x = (x[0] ^ x[1])[None]
                    continue
                third = len(x) // 3
                a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (c & half))
                x = np.concatenate([half ^ c, x[3 * third :]])
            total.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
            carried, p = np.concatenate(carries) if carries else carried[:0], p + 1
        return total, offset

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k rows of the highest scores, ties to smaller ids, without the rows of the id own.

        From the highest slice down, rows that are surely in and rows still equal to the boundary are kept
        apart; those left equal at the end are taken by id.
        """
        total, offset = self.scores(query)
        equal, sure = self.all & ~self.bitmap(self.ids == own), np.zeros(self.words, np.uint64)
        for s in reversed(total):
            better = sure | (equal & s)
            count = int(np.bitwise_count(better).sum())
            if count > k:
                equal = equal & s
            else:
                sure, equal = better, equal & ~s
                if count == k:
                    equal = np.zeros_like(equal)
                    break
        found = self.rows(sure)
        found = np.concatenate([found, self.rows(equal)[: k - len(found)]])
        value = np.full(len(found), offset, np.int64)
        for p, s in enumerate(total):
            value += ((s[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << p
        return self.ids[found], value


_BLOCK = "dim int, block long, ids array<long>, least array<long>, bits array<int>, slices binary"


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the index of each block of rows (dim, block, id, v) that come sorted by block."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []
    at: tuple | None = None

    def block() -> pa.RecordBatch:
        index = BitSlices.of(np.array(ids, np.int64), np.stack(vectors))
        row = {"dim": at[0], "block": at[1], "ids": index.ids.tolist(), "least": index.least.tolist(), "bits": index.bits, "slices": index.slices.tobytes()}
        ids.clear()
        vectors.clear()
        return pa.RecordBatch.from_pylist([row], pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("bits", pa.list_(pa.int32())), ("slices", pa.binary())]))

    for batch in batches:
        for dim, b, i, v in zip(*batch.columns, strict=True):
            if ids and at != (dim.as_py(), b.as_py()):
                yield block()
            at = (dim.as_py(), b.as_py())
            ids.append(i.as_py())
            vectors.append(v.values.to_numpy())
    if ids:
        yield block()


def _searched(k: int):
    """For batches of rows sorted by pair of blocks, in which an index stands before the queries that it is to answer, each query's k best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = None, None
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: B023, E731
                pair = (get("dim").as_py(), get("block").as_py(), get("group").as_py())
                if get("slices").is_valid:
                    index, at = BitSlices(get("ids").values.to_numpy(), get("least").values.to_numpy(), get("bits").as_py(), get("slices").as_py()), pair
                elif at == pair:  # else the block has no row
                    query = get("id").as_py()
                    found, score = index.top(get("v").values.to_numpy(), k, query)
                    out.append((np.full(len(found), query), found, score))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = 16_384, block_queries: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score (long): each query's k rows of the highest inner products.

    Vectors are quantised to floor(scale * x). is_query picks the queries; every row but those of the query's
    own id is a candidate; ties go to the smaller id. A query with fewer candidates gets all.

    Nulls and ties: rows without id, and vectors that are null or hold a null, NaN or infinity, take no part.
    Vectors meet only those of their length; an empty vector takes no part. Rows that repeat an id are
    candidates each; queries that repeat an id are asked each, and what they find is ranked together. Of rows
    equal in id and vector, k at most can be among the best, so no more are looked at. An empty table gives no
    row. Other columns are not read, whatever their names.

    Every query meets every row, in blocks: rows and queries are dealt by a hash of id and vector to blocks of
    about block_rows and block_queries, as many as their counts ask for. A block of rows is sliced once and its
    index (an eighth of its vectors) written to the shared folder. A task for each pair of blocks gets the
    index and then the queries, one by one; the number of tasks is that of pairs, which a first pass counts.
    """
    finite = F.forall(F.col("v"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    picked = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    usable = picked.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite).select("id", "q", quantised(F.col("v"), scale).alias("v")).withColumn("dim", F.size("v"))
    # a row for each length of vector, with the numbers of blocks
    blocks = durable(usable.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("n_blocks"), F.ceil(F.count_if("q") / block_queries).alias("n_groups")))
    count = blocks.agg(F.sum("n_blocks").alias("blocks"), F.sum(F.col("n_blocks") * F.col("n_groups")).alias("pairs")).first()
    tasks = lambda n: int(min(max(2 * (n or 0), 1), 20_000))  # twice as many as parts, so that few share one
    copies = F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")))
    once = usable.groupBy("dim", "id", "v").agg(F.count(F.lit(1)).alias("n"))
    dealt = once.select("dim", "id", "v", copies.alias("copy")).join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("id", "v", "copy"), F.col("n_blocks")))
    indexed = durable(dealt.select("dim", "block", "id", "v").repartition(tasks(count["blocks"]), "dim", "block").sortWithinPartitions("dim", "block").mapInArrow(_sliced, _BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = indexed.join(blocks.where("n_groups > 0"), "dim").select("dim", "block", every("n_groups").alias("group"), "ids", "least", "bits", "slices", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<long>").alias("v"))
    queries = usable.where("q").groupBy("dim", "id", "v").agg(F.count(F.lit(1)).alias("n")).select("dim", "id", "v", copies.alias("copy")).join(blocks, "dim")
    asked = queries.withColumn("group", F.pmod(F.xxhash64(F.lit(1), "id", "v", "copy"), F.col("n_groups"))).select("dim", every("n_blocks").alias("block"), "group", "id", "v")
    met = left.unionByName(asked, allowMissingColumns=True).repartition(tasks(count["pairs"]), "dim", "block", "group").sortWithinPartitions("dim", "block", "group", F.col("slices").isNull())
    found = met.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
