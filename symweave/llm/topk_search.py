"""Exact top-k search by inner product: an impact-ordered index, processed score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.llm.common import stored

#: Rows of an index block and queries of a query block, in the mean: what one task holds at once.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Queries that are scored together.
TOGETHER = 256
#: Share of the vectors' length that is still to come up to which a proof is tried, and members of the result, as a
#: multiple of k, up to which scoring them again is cheaper than further segments. Both change time only.
TRY_BELOW, FEW = 0.3, 16


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as integer components; those null or holding null or non-finite components are left out."""
    for batch in batches:
        ids, vectors = [], []
        for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector"), strict=True):
            if vec_id is None or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                if (np.abs(x) >= 2.0**56).any():
                    raise OverflowError(f"vector {vec_id}: 64 times a component does not fit 63 bits")
                ids.append(vec_id)
                vectors.append(np.floor(64 * x).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(v) for v in vectors], pa.int32()), pa.array(vectors, pa.list_(pa.int64()))], ["vec_id", "dim", "v"])


class ImpactIndex:
    """Posting segments of one block of vectors, by descending quantised impact.

    A component's impact is its magnitude, quantised to the power of two below it. A segment holds the postings of one
    impact and one dimension: the places of the vectors, and their components. levels has the segments of each impact,
    the largest first. rest has, for each level, the length of each vector without the postings up to it: with a query's
    length it bounds, by Cauchy and Schwarz, what the segments still to come can change.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        flat = vectors.T.ravel()  # by dimension, so that a segment is one run of it
        impact = np.where(flat == 0, 0, np.frexp(np.abs(flat.astype(np.float64)))[1]).astype(np.int64)
        order = np.argsort(-impact * dims + np.repeat(np.arange(dims), n), kind="stable")
        order = order[: np.count_nonzero(impact)]
        place, value = order % max(n, 1), flat[order]
        segment = -impact[order] * dims + order // max(n, 1)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
        self.levels: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.rest: list[np.ndarray] = []
        whole = (vectors.astype(np.float64) ** 2).sum(axis=1)
        left = whole.copy()
        for a, b in zip(cuts, cuts[1:]):
            if not self.levels or impact[order[a]] != impact[order[a - 1]]:
                self.levels.append([])
            self.levels[-1].append((int(order[a] // n), place[a:b], value[a:b]))
            left[place[a:b]] -= value[a:b].astype(np.float64) ** 2
            if b == len(order) or impact[order[b]] != impact[order[a]]:
                self.rest.append(np.sqrt(np.maximum(left, 0) + 1e-9 * whole))  # no less than it is, whatever was rounded

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, place in the block, score) of the k best for each query, ties to smaller ids. own: each query's own
        place in the block, or -1. Segments are processed for all queries that are still open, one level after another; a
        query ends where few enough vectors can still be among its best. Those are scored again, exactly."""
        n, length = len(self.ids), np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        most = float(length.max(initial=0)) * float(np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        if most >= 2.0**63:
            raise OverflowError("a score does not fit 64 bits")
        kind = np.float32 if most < 2**23 else np.float64  # float32 is exact below 2^24, float64 below 2^53
        some, whole = min(k, max(n - 1, 0)), np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1)).sum()
        members: list[np.ndarray | None] = [None] * len(queries)
        open_ = np.arange(len(queries))
        score = np.zeros((n, len(queries)), kind)  # a posting's scores of all open queries lie side by side
        asked = np.ascontiguousarray(queries.T.astype(kind))
        exact = most < 2**52
        for level, rest in zip(self.levels, self.rest, strict=True):
            if not some or not exact:
                break
            for dim, place, value in level:
                score[place] += value.astype(kind)[:, None] * asked[dim]
            if rest.sum() > TRY_BELOW * whole:
                continue
            gap = np.multiply.outer((rest * (1 + 1e-6)).astype(kind), length[open_].astype(kind)) + kind(1)  # no less, rounded
            low = score - gap
            inside = np.flatnonzero(own[open_] >= 0)
            low[own[open_[inside]], inside] = -np.inf
            least = np.partition(low, n - some, axis=0)[n - some]
            may = score + gap >= least
            may[own[open_[inside]], inside] = False
            done = np.count_nonzero(may, axis=0) <= FEW * k  # proof: nothing outside can reach the k-th lower bound
            for i in np.flatnonzero(done):
                members[open_[i]] = np.flatnonzero(may[:, i])
            if done.any():
                keep = ~done
                open_, score, asked = open_[keep], np.ascontiguousarray(score[:, keep]), np.ascontiguousarray(asked[:, keep])
            if not len(open_):
                break
        column = {int(q): i for i, q in enumerate(open_)}
        rows, places, scores = [], [], []
        for i, found in enumerate(members):
            if found is None:
                found = np.arange(n)
                if exact and n > some + 1:  # all segments were processed: these scores are the exact ones
                    s = score[:, column[i]].copy()
                    if own[i] >= 0:
                        s[own[i]] = -np.inf
                    found = np.flatnonzero(s >= np.partition(s, n - some)[n - some])
                found = found[found != own[i]]
            s = self.vectors[found] @ queries[i]
            best = np.lexsort((found, self.ids[found], -s))[:k]
            rows.append(np.full(len(best), i))
            places.append(found[best])
            scores.append(s[best])
        return np.concatenate(rows), np.concatenate(places), np.concatenate(scores)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each query: query_id, rank, vec_id, score.

    Components x are taken as floor(64 * x). Queries are the rows whose id is divisible by every, candidates all other
    rows, of as many dimensions. Ties go to the smaller id; queries with fewer candidates get all. Ids and vectors that
    are null, and vectors with null or non-finite components, take no part. Rows that share an id, or are copies of each
    other, are rows of their own: each is a candidate of all others, and each asks for itself, so that a repeated query
    id has its ranks once for each row. Components and scores must fit 64 bits, else the query fails with OverflowError.
    An empty table gives no rows; other columns, whatever their names, have no part.

    Rows are dealt to index blocks and queries to query blocks by row, both of bounded size; each task builds the index
    of one block and runs one block of queries over it. Only the best k of a block go on.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    found = stored(rows.mapInArrow(_quantise, "vec_id bigint, dim int, v array<bigint>").select(F.monotonically_increasing_id().alias("row"), "*"))
    n = max(1, found.count())
    blocks, query_blocks = -(-n // BLOCK_ROWS), -(-n // (every * BLOCK_QUERIES))
    blocks = max(blocks, min(8, -(-n // 512)))
    index = found.select("*", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    asked = found.where(F.col("vec_id") % every == 0)
    asked = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            right = right.sort_values(["vec_id", "row"])
            ids, place = right["vec_id"].to_numpy(), {r: i for i, r in enumerate(right["row"])}
            index = ImpactIndex(ids, np.stack(right["v"].to_numpy()))
            asking, row = left["vec_id"].to_numpy(), left["row"].to_numpy()
            own, q = np.array([place.get(r, -1) for r in row]), np.stack(left["v"].to_numpy())
            for at in range(0, len(q), TOGETHER):
                i, found_at, score = index.search(own[at : at + TOGETHER], q[at : at + TOGETHER], k)
                out.append((row[at + i], asking[at + i], ids[found_at], score))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("row", "query_id", "vec_id", "score"), cols, strict=True)))

    keys = ("block", "query_block", "dim")
    best = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(search, "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
