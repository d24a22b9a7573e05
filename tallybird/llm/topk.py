"""Exact top-k inner products by term-at-a-time accumulation.

Vectors are sparse rows of integer weights, a term for each component. Candidates and queries are
dealt to blocks of bounded size; every pair of a query block and a candidate block is one group. A
group goes through the terms: the queries that hold the term scatter its weighted postings into their
rows of a dense score array. Partition selection keeps the best ``k`` of each row, and a ranked
window merges the blocks. All candidates are scored: work is the product of queries and rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybird.llm.staging import staged

SCALE = 64
K = 20
CANDIDATES = 4096
QUERIES = 512
_TILE = 64


def integer_weights(embedding, scale: int = SCALE):
    """floor(scale * x) of every component as array<long>; null for a vector that is null or holds
    a null or non-finite component."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _matrix(lists: pa.ChunkedArray, terms: int) -> np.ndarray:
    """Rows of weights, 0 where a vector is shorter than others."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), terms), np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    first = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
    out[row, np.arange(len(row)) - np.repeat(first, lengths)] = lists.flatten().to_numpy()
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all queries against all candidates, term by term, in the narrowest integers that
    hold every sum."""
    norms = [np.sqrt((x.astype(np.float64) ** 2).sum(1)).max(initial=0) for x in (queries, candidates)]
    bound = norms[0] * norms[1] * 1.001 + 1  # no sum over some of the terms exceeds the norms
    kind = np.int16 if bound < 1 << 15 else np.int32 if bound < 1 << 31 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    postings = []
    for term in range(candidates.shape[1]):
        holders = np.flatnonzero(candidates[:, term])
        if len(holders):
            full = 2 * len(holders) > len(candidates)
            holders = slice(None) if full else holders
            postings.append((term, holders, candidates[holders, term].astype(kind)))
    small = queries.astype(kind)
    for low in range(0, len(queries), _TILE):
        tile = scores[low : low + _TILE]
        part = small[low : low + _TILE]
        for term, holders, weights in postings:
            rows = np.flatnonzero(part[:, term])
            if isinstance(holders, slice):
                if len(rows) == len(part):
                    tile += part[:, term, None] * weights
                elif len(rows):
                    tile[rows] += part[rows, term, None] * weights
            elif len(rows):
                tile[np.ix_(rows, holders)] += part[rows, term, None] * weights
    return scores


def _best(k: int):
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def best(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = np.asarray(table.column("asks").to_numpy(), bool)
        if asks.all() or not asks.any():
            return schema.empty_table()
        uid = table.column("uid").to_numpy()
        ids = table.column("vec_id")
        empty = np.asarray(ids.is_null())
        number = np.asarray(ids.fill_null(0))
        lists = table.column("weights")
        terms = max((len(x) for x in lists), default=0)
        weights = _matrix(lists, max(terms, 1))
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        c = c[np.lexsort((number[c], empty[c]))]  # ties then go to the smaller id, null last
        scores = accumulate(weights[q], weights[c])
        place = {u: n for n, u in enumerate(uid[c].tolist())}
        out = []
        take = min(k, len(c))
        for row, query in enumerate(q):
            score = scores[row].astype(np.int64)
            own = place.get(int(uid[query]))
            limit = np.partition(score, len(c) - take)[len(c) - take]
            if own is not None and score[own] >= limit:  # one more, as the own row goes
                more = min(take + 1, len(c))
                limit = np.partition(score, len(c) - more)[len(c) - more]
            above = np.flatnonzero(score > limit)
            ties = np.flatnonzero(score == limit)
            pick = np.concatenate([above, ties[ties != own][:take]])
            pick = pick[pick != own]
            pick = pick[np.lexsort((pick, -score[pick]))][:k]
            out.append((np.full(len(pick), query), c[pick], score[pick]))
        query, found, score = (np.concatenate(x) for x in zip(*out))
        return pa.table(
            [
                pa.array(uid[query]),
                pa.array(number[query]),
                pa.array(number[found], mask=empty[found]),
                pa.array(score),
            ],
            schema=schema,
        )

    return best


def exact_top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's
    own. Rows with a null, null-holding or non-finite vector take no part. Of rows that share an id
    each is a row of its own: each asks, and each is a candidate of the others. Null ids are
    candidates, last among ties. Vectors of different lengths count as ending in zeros; fewer than
    ``k`` candidates give fewer rows; an empty table gives none. Other columns are not read.
    """
    rows = vectors.select(
        vectors[vec_id].cast("long").alias("vec_id"), integer_weights(vectors[embedding], scale).alias("weights")
    ).where("weights IS NOT NULL")
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")  # ids settle as written
    asks = rows.where(F.col("vec_id") % every == 0)
    c_blocks = -(-max(rows.count(), 1) // CANDIDATES)
    q_blocks = -(-max(asks.count(), 1) // QUERIES)
    columns = ["uid", "vec_id", "weights"]
    spread = F.xxhash64("uid")
    pairs = rows.select(
        F.pmod(spread, F.lit(c_blocks)).alias("c"),
        F.explode(F.expr(f"sequence(0L, {q_blocks - 1}L)")).alias("q"),
        *columns,
        F.lit(False).alias("asks"),
    ).unionAll(
        asks.select(
            F.explode(F.expr(f"sequence(0L, {c_blocks - 1}L)")).alias("c"),
            F.pmod(spread, F.lit(q_blocks)).alias("q"),
            *columns,
            F.lit(True).alias("asks"),
        )
    )
    found = pairs.groupBy("c", "q").applyInArrow(_best(k), "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
