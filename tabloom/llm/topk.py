"""Operator 9: exact top-k search by the threshold algorithm.

Vectors become integers and are taken in blocks of bounded size; a block keeps each dimension as a sorted list. For each
query the algorithm reads every list downwards from the end that the sign of the query's component asks for, in rounds of
doubling depth; a vector seen in any list is looked up in full. A query is done with a block when the bound of the next
list places is below its k-th score, so no unseen vector could reach or tie it. Only the places that are walked are touched. The k-th score is carried from block to
block within a task: a block whose list heads cannot reach it is left unread. Results of blocks are merged by a window.

While the queries take up BROADCAST_BYTES at most they are broadcast, and candidates stay where they are read. Beyond
that, both sides are dealt to blocks by a hash, and each query block meets each candidate block as one pair of rows.

Vectors of random directions in many dimensions are the hard case: a list is read in part, but every vector turns up near
the end of some list. On clustered vectors the bound stops most of the reading. `Reads` counts both.

Ties go to the smaller id. Null vectors, null ids and vectors with null, NaN or infinite components take no part; vectors
of different lengths are compared as if padded with zeros, an empty one scoring 0 with all. Sums are exact: floats where
products stay below their precision, else Python integers; a result that does not fit a long raises an error. Rows that
repeat an id are candidates of their own, except for queries with that id; equal query rows are answered once. An empty
table gives no rows. Only the two named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table

K = 20
SCALE = 64
#: Vectors in a candidate block and in a query block, at most and on average.
BLOCK, QUERIES = 8192, 2048
#: Queries are broadcast up to this size, as doubles.
BROADCAST_BYTES = 64 << 20
#: Tasks for each core in which pairs of blocks are searched, at most.
TASKS = 16


@dataclass
class Reads:
    """How much searches have read, of how much there was: list entries, and vectors in full."""

    entries: int = 0
    all_entries: int = 0
    vectors: int = 0
    all_vectors: int = 0


class Block:
    """Vectors with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n = len(ids)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.lists = np.take_along_axis(vectors, order, axis=0)
        #: The rows in each list's order, a list after the other.
        self.rows = np.ascontiguousarray(order.T.astype(np.uint16 if n <= 1 << 16 else np.uint32))
        self.most = np.abs(vectors).max(initial=0)
        self.exact: dict[type, np.ndarray] = {}

    def typed(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and lists in a type in which sums are exact."""
        if kind not in self.exact:
            self.exact[kind] = tuple(_integers(x) if kind is object else x.astype(kind) for x in (self.vectors, self.lists))
        return self.exact[kind]

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None, reads: Reads) -> tuple[list[int], list[int]]:
        """Ids and scores, best first, of the k best that may reach `floor`, which k vectors elsewhere have reached.

        The lists of components that are not 0 are walked, as the others move no bound; a vector that none of them has
        brought up by the end scores 0 like all that are left.
        """
        n, dims = self.vectors.shape
        reads.all_entries += n * dims
        reads.all_vectors += n
        size = float(self.most) * np.abs(query).max(initial=0) * max(1, dims)
        kind = np.float32 if size < 2**24 else np.float64 if size < 2**53 else object
        vectors, lists = self.typed(kind)
        q = _integers(query) if kind is object else query.astype(kind)
        high, low = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        bound = lambda d: (q[high] * lists[n - 1 - d, high]).sum() + (q[low] * lists[d, low]).sum()
        if floor is not None and bound(0) < floor:
            return [], []
        unmet = np.ones(n, bool)
        best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
        depth, upto = 0, min(k, n)
        while True:
            walked = np.concatenate([self.rows[high, n - upto : n - depth].ravel(), self.rows[low, depth:upto].ravel()])
            reads.entries += len(walked)
            met = np.zeros(n, bool)
            met[walked] = True
            fresh = np.flatnonzero(met & unmet if upto < n else unmet)
            unmet[fresh] = False
            reads.vectors += len(fresh)
            fresh = fresh[self.ids[fresh] != query_id]
            best_ids, best = _best(np.concatenate([best_ids, self.ids[fresh]]), np.concatenate([best, vectors[fresh] @ q]), k)
            if not unmet.any():
                break
            if len(best) == k:
                floor = best[-1] if floor is None else max(floor, best[-1])
            if floor is not None and bound(upto) < floor:
                break
            depth, upto = upto, min(2 * upto, n)
        return best_ids.tolist(), [int(x) for x in best.tolist()]


def _integers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel().tolist()]
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, in order; all that tie with the k-th count until ids decide."""
    if len(scores) > 4 * k and scores.dtype != object:
        kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[kept], scores[kept]
    at = np.array(sorted(range(len(ids)), key=lambda x: (-scores[x], ids[x])), int) if scores.dtype == object else np.lexsort((ids, -scores))
    return ids[at[:k]], scores[at[:k]]


def integer_rows(ids: pa.Array, column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(scale * x) of the rows that take part, as doubles, which hold these whole numbers exactly."""
    if isinstance(column.type, pa.FixedSizeListType) or pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    there = pc.and_(ids.is_valid(), column.is_valid())
    ids, column = ids.filter(there).to_numpy(zero_copy_only=False).astype(np.int64), column.filter(there)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(ids)), sizes)
    sound = np.bincount(row, ~np.isfinite(flat), len(ids)) == 0
    out = np.zeros((len(ids), int(sizes.max(initial=0))))
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    with np.errstate(over="ignore"):
        out = np.floor(scale * out[sound])
    if not np.isfinite(out).all():
        raise ValueError("a component is too large to be scaled")
    return ids[sound], out


def _widen(x: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x


def search_blocks(blocks: Iterator[tuple[np.ndarray, np.ndarray]], query_ids: np.ndarray, queries: np.ndarray, k: int, reads: Reads | None = None) -> Iterator[tuple[int, list[int], list[int]]]:
    """(query place, ids, scores) of each query and block in turn; the k best overall are among them."""
    reads = reads or Reads()
    held: list[list[int]] = [[] for _ in query_ids]  # each query's best scores so far
    for ids, vectors in blocks:
        dims = max(vectors.shape[1], queries.shape[1])
        block, asked = Block(ids, _widen(vectors, dims)), _widen(queries, dims)
        for x, own in enumerate(query_ids.tolist()):
            found, scores = block.search(own, asked[x], k, held[x][-1] if len(held[x]) == k else None, reads)
            if found:
                held[x] = sorted([*held[x], *scores], reverse=True)[:k]
                yield x, found, scores


def _result(found: Iterator[tuple[int, list[int], list[int]]], query_ids: np.ndarray, asked: int) -> Iterator[pa.RecordBatch]:
    rows: list[list] = [[], [], [], [], []]

    def batch() -> pa.RecordBatch:
        try:
            columns = [pa.array(x, t) for x, t in zip(rows, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)]
        except (OverflowError, pa.ArrowInvalid) as e:
            raise ValueError("a score does not fit 64 bits") from e
        return pa.RecordBatch.from_arrays(columns, ["asked", "place", "query_id", "vec_id", "score"])

    for place, ids, scores in found:
        for column, values in zip(rows, ([asked] * len(ids), [place] * len(ids), [int(query_ids[place])] * len(ids), ids, scores), strict=True):
            column += values
        if len(rows[0]) >= 10_000:
            yield batch()
            rows = [[], [], [], [], []]
    if rows[0]:
        yield batch()


_FOUND = "asked int, place int, query_id bigint, vec_id bigint, score bigint"


def _distinct_rows(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = sorted({(int(i), v.tobytes()): n for n, (i, v) in enumerate(zip(ids, x, strict=True))}.values())
    return ids[at], x[at]


def _by_broadcast(rows: DataFrame, asked: pa.Table, k: int, scale: int) -> DataFrame:
    column = asked.column("vector").combine_chunks()
    shipped = rows.sparkSession.sparkContext.broadcast(_distinct_rows(*integer_rows(asked.column("vec_id").combine_chunks(), column, scale)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                if n + part.num_rows > BLOCK and held:
                    yield integer_rows(*_joined(held), scale)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield integer_rows(*_joined(held), scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shipped.value
        yield from _result(search_blocks((x for x in blocks(batches) if len(x[0])), ids, queries, k), ids, 0)

    return rows.mapInArrow(run, _FOUND)


def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole.column(0).combine_chunks(), whole.column(1).combine_chunks()


def _packed(rows: DataFrame, size: int, scale: int) -> tuple[DataFrame, int]:
    """One row for each block: (block, ids, flat, dims), by a hash of the id and the vector."""
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        ids, x = integer_rows(t.column("vec_id").combine_chunks(), t.column("vector").combine_chunks(), scale)
        small = x.astype(np.int16) if np.abs(x).max(initial=0) < 2**15 else x
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "ids": [ids.tobytes()], "flat": [small.tobytes()], "dims": pa.array([x.shape[1]], pa.int32()), "narrow": [small is not x]})

    return dealt.groupBy("block").applyInArrow(run, "block int, ids binary, flat binary, dims int, narrow boolean"), blocks


def _unpacked(ids: bytes, flat: bytes, dims: int, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(flat, np.int16 if narrow else np.float64).astype(np.float64).reshape(len(ids), dims)


def _by_blocks(rows: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    cand, n_cand = _packed(rows, BLOCK, scale)
    asked, n_asked = _packed(queries.distinct(), QUERIES, scale)
    left = cand.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = asked.select(F.col("block").alias("asked"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "flat", "dims", "narrow")))
    # Blocks of one query block that meet in a task share its k-th scores.
    tasks = min(n_cand * n_asked, TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    pairs = left.join(right.hint("shuffle_hash"), "asked").repartition(tasks, "asked", F.col("block") % max(1, n_cand // 4)).sortWithinPartitions("asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = {}

        def blocks(asked: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal row
            while row and row["asked"] == asked:
                ids, v = _unpacked(row["ids"], row["flat"], row["dims"], row["narrow"])
                row = next(rows, {})
                if len(ids):
                    yield ids, v

        rows = (b.slice(x, 1).to_pylist()[0] for b in batches for x in range(b.num_rows))
        row = next(rows, {})
        while row:
            asked = row["asked"]
            ids, queries = _unpacked(row["q_ids"], row["q_flat"], row["q_dims"], row["q_narrow"])
            yield from _result(search_blocks(blocks(asked), ids, queries, k), ids, asked)

    return pairs.select("ids", "flat", "dims", "narrow", "asked", "q_ids", "q_flat", "q_dims", "q_narrow").mapInArrow(run, _FOUND)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best."""
    named = lambda df: df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id is not null and vector is not null")
    rows, queries = named(vectors), named(vectors.where(is_query))
    n, dims = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if n * (dims + 1) * 8 <= BROADCAST_BYTES:
        found = _by_broadcast(rows, queries.toArrow(), k, scale)
    else:
        found = _by_blocks(rows, queries, k, scale)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by asked, place order by score desc, vec_id)").cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
q as (select vec_id as query_id, e as qe from v where vec_id % 20 = 0),
s as (select query_id, vec_id, list_inner_product(qe::double[], e::double[])::bigint as score from q join v on v.vec_id <> q.query_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
