"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Candidates and queries are dealt into blocks, and each pair of blocks is one group.  In a group every
dimension of the candidates is a list sorted by value, which a query reads from the end that gives it
the most, in order only and in growing steps.  What it has read gives each candidate a lower bound
(the products seen, and the least that the lists not yet seen at can give) and an upper bound (the
products seen, and what each such list gives next).  The lists whose next and last entries differ most
are read on first, since they hold most of what is uncertain.  A query stops once no more than a few
candidates have an upper bound that reaches the k-th lower bound; the lists are then read on for those
few only, until their scores are known.  The k best of all blocks are merged by rank, limited before
the shuffle.

Sums are exact in float64 below 2^53.  Where larger values occur, the bounds are widened by more than
what rounding can do, and the scores of what is left are int64 products (scores must fit a long;
beyond it they wrap).

Every query meets every candidate block, which is the task; a block pair's memory is set by BLOCK and
QUERY_BLOCK.  Rows are dealt by a hash of id and place in the table, so no block grows with the data
even if one id or one vector holds a third of all rows.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
vectors of different lengths don't meet, and of any length are compared whole; rows that repeat a
vec_id are candidates each, never meet rows of their own id, and as queries share their id's k best;
ties go to the smaller vec_id; a query without candidates has no rows; an empty table gives an empty
result; columns other than vec_id and v are not read, whatever their names.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14
QUERY_BLOCK = 256
#: Steps of a list, as shares of it.
STEPS = (1 / 256, 1 / 64, 1 / 16, 1.0)


def quantize(embedding: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as array<long>, or null where a component is null or not finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    x = F.transform(e, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(e) > 0) & ~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


class Lists:
    """A block's candidates as sorted lists, one for each dimension, in both directions."""

    def __init__(self, cand: np.ndarray, ids: np.ndarray):
        self.cand, self.ids = cand, ids
        n = len(cand)
        up = np.argsort(cand, axis=0, kind="stable").T.astype(np.int32)
        value = np.take_along_axis(cand.T, up, axis=1).astype(np.float64)
        self.place = np.stack([up, up[:, ::-1]])  # [direction, dimension, rank]
        self.value = np.stack([value, value[:, ::-1]])
        self.whole = np.ascontiguousarray(cand.T, dtype=np.float64)
        self.steps = np.unique([0, *(max(1, int(n * s)) for s in STEPS)])
        self.largest = float(np.abs(cand).max(initial=0))

    def search(self, query: np.ndarray, own_id: int, k: int, few: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """(places, scores) of one query's k best, and the share of all entries read until it stopped."""
        n, dims = self.cand.shape
        few = max(4 * k, n // 256) if few is None else few
        most = 2.0 * dims * self.largest * float(np.abs(query).max(initial=0))
        # What rounding can make of any of the sums; nothing where all integers are exact.
        margin = 0.0 if most < 2**53 else 8 * dims * most * 2.0**-52
        q, d = query.astype(np.float64), np.arange(dims)
        way = (q > 0).astype(int)
        worst = q * self.value[way, d, -1]
        gap = q * self.value[way, d, 0] - worst  # between what a list gives next and what it ends with
        at = np.zeros(dims, int)
        low, slack = np.full(n, worst.sum()), np.full(n, gap.sum())
        own = self.ids == own_id
        low[own] = -np.inf
        others = n - int(own.sum())
        left = ~own
        read = 0
        while others > few and (top := gap.max()) > 0:
            for step in np.unique(at[gap >= top / 2]):
                of = np.flatnonzero((gap >= top / 2) & (at == step))
                a, b = self.steps[step], self.steps[step + 1]
                place = self.place[way[of], of, : b if b < n else a]
                new = place[:, a:].ravel()
                if b < n:
                    gives = self.value[way[of], of, a:b] * q[of, None] - worst[of, None]
                    low += np.bincount(new, weights=gives.ravel(), minlength=n)
                else:  # the rest of a list is all candidates but those seen, which is summed faster in their own order
                    low += q[of] @ self.whole[of] - worst[of].sum()
                    if a:
                        low -= np.bincount(place[:, :a].ravel(), weights=(self.value[way[of], of, :a] * q[of, None] - worst[of, None]).ravel(), minlength=n)
                before = gap[of].copy()
                after = q[of] * self.value[way[of], of, b] - worst[of] if b < n else np.zeros(len(of))
                slack += (after - before).sum()
                # Candidates seen earlier in these lists don't change; those seen now have nothing open there.
                if a:
                    slack += np.bincount(place[:, :a].ravel(), weights=np.repeat(before - after, a), minlength=n)
                if b < n:
                    slack -= np.bincount(new, weights=np.repeat(after, b - a), minlength=n)
                gap[of], at[of] = after, step + 1
                read += len(of) * (b - a)
            kth = np.partition(low, n - k)[n - k]
            left &= low + slack + margin >= kth - margin
            if np.count_nonzero(left) <= few:
                break
        found = np.flatnonzero(left)
        if margin:
            score = (self.cand[found] * query).sum(axis=1)
        else:
            for step in np.unique(at[gap > 0]):  # read on for what is left
                of = np.flatnonzero((at == step) & (gap > 0))
                a = self.steps[step]
                place = self.place[way[of], of, a:]
                row, col = np.nonzero(left[place])
                low += np.bincount(place[row, col], weights=self.value[way[of[row]], of[row], a + col] * q[of[row]] - worst[of[row]], minlength=n)
            score = low[found].astype(np.int64)
        best = np.lexsort((self.ids[found], -score))[:k]
        return found[best], score[best], read / max(n * dims, 1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors(vec_id, v array<long>), queries likewise -> query_id, rank, vec_id, score."""
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("dims"), F.monotonically_increasing_id().alias("nth"))
    queries = queries.where("vec_id is not null and v is not null").select("vec_id", "v", F.size("v").alias("dims"), F.monotonically_increasing_id().alias("nth"))
    n, m = vectors.count(), queries.count()
    c_blocks, q_blocks = -(-n // block) or 1, -(-m // query_block) or 1
    by_hash = lambda parts: F.pmod(F.xxhash64("vec_id", "nth"), F.lit(parts)).cast("int")
    q = queries.select("vec_id", "v", "dims", by_hash(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    c = vectors.select("vec_id", "v", "dims", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), by_hash(c_blocks).alias("cb"))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({x: pd.Series(dtype="int64") for x in columns})
        lists = Lists(np.stack(right["v"]), right["vec_id"].to_numpy())
        found = []
        for i, v in zip(left["vec_id"].to_numpy(), left["v"]):
            at, score, _ = lists.search(np.asarray(v), i, k)
            found.append(pd.DataFrame({"query_id": i, "vec_id": lists.ids[at], "score": score}))
        return pd.concat(found)

    keys = ("dims", "qb", "cb")
    pairs = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(pair, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
