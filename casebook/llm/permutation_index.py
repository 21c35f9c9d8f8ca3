"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors of the commonest width, a bounded sample with the smallest hashes, are the pivots. Every vector is represented by the numbers
of its ``PREFIX`` nearest pivots in order. It is posted in the file of the nearest of the first ``FILES`` pivots, and a
query visits the files of its ``VISITS`` nearest of these, and on until they hold ``LOOKS`` rows and one more than it asks for, whatever the table's size. Files are dealt to blocks of about
``BLOCK_ROWS`` rows, several small files to one, and a file that is larger (very common vectors) to several by
hash, so every row is kept once and no block is hot. Within a block the prefixes are inverted files: for each pivot the rows that
hold it with their places there. A query meets only the postings of its own pivots; candidates are ranked by footrule distance
(a pivot missing from one prefix counts as at place PREFIX), the ``RERANK`` best of a block are reranked by the
exact measure, and a query's answers from its blocks are merged, k from each.

If fewer than k candidates of a block share a pivot with the query, the block's other rows are reranked too, so small tables
return all candidates; up to ``RERANK`` rows the answer is exact. ``visits=files`` with ``rerank=block_rows`` is an exact search at any size.
Measured recall against brute force is in the README (at least 0.9 is asked for).

Distances hold between vectors of one width, so each width has blocks of its own; pivots are cut or filled up with zeros to
another width, which only decides what is met.

Defined cases: vectors that are null, zero, empty, or that hold a null or non-finite component take no part, as row
or as query; nor do rows without an id. Ties in distance go to the smaller id. Repeated rows are candidates each by itself; a query's own id is
not. An empty table gives an empty result. Only the id and vector columns (and those that ``queries`` names) are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIVOTS, PREFIX = 512, 128
FILES, VISITS = 64, 48
BLOCK_ROWS, RERANK = 16_384, 512
LOOKS = 16_384  # rows that the files a query visits hold at least
PIVOT_BYTES = 1 << 26  # of all pivots together, which go to every task
SHAPE = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fitted(pivots: np.ndarray, width: int) -> np.ndarray:
    """Pivots cut or filled up to a width."""
    return np.pad(pivots, ((0, 0), (0, max(0, width - pivots.shape[1]))))[:, :width]


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first (ties: smaller number)."""
    d = (vectors**2).sum(1)[:, None] - 2 * vectors @ pivots.T + (pivots**2).sum(1)[None, :]
    return np.argsort(d, axis=1, kind="stable")[:, :length]


class Block:
    """One block's vectors and its inverted files: for each pivot the rows that hold it, and the place where."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, files: np.ndarray, pivots: np.ndarray, length: int):
        order = np.argsort(ids, kind="stable")  # then positions rank ties by id
        self.ids, self.vectors, self.files, self.length = ids[order], vectors[order], files[order], length
        orders = prefixes(self.vectors, pivots, length)
        flat = np.argsort(orders.ravel(), kind="stable")
        self.rows, self.places = flat // length, flat % length
        self.ends = np.searchsorted(orders.ravel()[flat], np.arange(len(pivots) + 1))

    def nearest(self, query_id: int, query: np.ndarray, order: np.ndarray, visits: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        # the footrule starts as if no pivot were shared, and each posting met corrects it
        n, saved = self.length, np.zeros(len(self.ids), np.int64)
        for place, pivot in enumerate(order):
            at = slice(self.ends[pivot], self.ends[pivot + 1])
            rows, there = self.rows[at], self.places[at]
            saved[rows] += (n - place) + (n - there) - np.abs(place - there)
        saved[(self.ids == query_id) | ~np.isin(self.files, visits)] = -1
        met = np.flatnonzero(saved > 0)
        if len(met) < k:
            met = np.flatnonzero(saved >= 0)
        if len(met) > rerank:
            met = met[np.argsort(-saved[met], kind="stable")[:rerank]]
        # summed in the order of the components, as any engine would
        d = np.sqrt(np.cumsum((self.vectors[met] - query) ** 2, axis=1)[:, -1])
        best = np.lexsort((self.ids[met], d))[:k]
        return self.ids[met][best], d[best]


class Layout(NamedTuple):
    """Where the files of one width lie: rows of each, first block and number of blocks; ``whole``: all in one block (which decides nothing)."""

    rows: np.ndarray
    first: np.ndarray
    count: np.ndarray
    whole: bool


def layout(rows: np.ndarray, block_rows: int) -> Layout:
    """Deals files to blocks: neighbours share one until it is full, and a file larger than a block has several."""
    first, count, at, used = [], [], 0, 0
    for n in rows:
        blocks = max(1, -(-int(n) // block_rows))
        if blocks > 1 or used + n > block_rows:
            at, used = at + (used > 0), 0
        first.append(at)
        count.append(blocks)
        at, used = (at + blocks, 0) if blocks > 1 else (at, used + n)
    return Layout(rows, np.array(first), np.array(count), at + (used > 0) <= 1)


def _filed(batches: Iterator[pd.DataFrame], pivots: np.ndarray) -> Iterator[pd.DataFrame]:
    """Adds each vector's file."""
    for batch in batches:
        width, file = batch["vector"].map(len), np.zeros(len(batch), np.int64)
        for w in width.unique():
            of = np.flatnonzero(width == w)
            file[of] = prefixes(np.stack(batch["vector"].iloc[of]), fitted(pivots, w), 1)[:, 0]
        yield batch.assign(width=width, file=file)


def _visiting(batches: Iterator[pd.DataFrame], pivots: np.ndarray, layouts: dict[int, Layout], visits: int, k: int, looks: int) -> Iterator[pd.DataFrame]:
    """A row for each block that a query goes to, with the files to look at there."""
    for batch in batches:
        out = []
        for vec_id, vector in zip(batch["vec_id"], batch["vector"], strict=True):
            of = layouts[len(vector)]
            order = prefixes(vector[None, :], fitted(pivots, len(vector)), len(pivots))[0]
            enough = int(np.searchsorted(np.cumsum(of.rows[order]), max(k + 1, looks))) + 1
            files = order[: max(visits, enough)]
            files = files[of.rows[files] > 0]
            blocks: dict[int, list[int]] = {}
            for f in files:
                for b in range(of.first[f], of.first[f] + of.count[f]):
                    blocks.setdefault(b, []).append(f)
            out += [(vec_id, vector, len(vector), b, fs) for b, fs in blocks.items()]
        yield pd.DataFrame(out, columns=["vec_id", "vector", "width", "block", "visits"])


def _answered(rows: pd.DataFrame, queries: pd.DataFrame, pivots: np.ndarray, length: int, k: int, rerank: int) -> pd.DataFrame:
    out = []
    if len(rows) and len(queries):
        own = fitted(pivots, int(rows["width"].iloc[0]))
        block = Block(rows["vec_id"].to_numpy(), np.stack(rows["vector"]), rows["file"].to_numpy(), own, length)
        orders = prefixes(np.stack(queries["vector"]), own, length)
        for q, v, order, visits in zip(queries["vec_id"], queries["vector"], orders, queries["visits"], strict=True):
            ids, d = block.nearest(q, v, order, visits, k, rerank)
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": d}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """The n different vectors of the commonest width with the smallest hashes (fewer if very wide): a bounded sample that depends on the values only."""
    widths = vectors.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    width = widths.orderBy(F.desc("n"), "width").first()["width"]
    n = max(1, min(n, PIVOT_BYTES // (8 * width)))
    distinct = vectors.where(F.size("vector") == width).select("vector").distinct()
    return np.array([r["vector"] for r in distinct.orderBy(F.xxhash64("vector"), F.hash("vector")).limit(n).collect()], float)


def search(
    df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, pivots: int = PIVOTS, length: int = PREFIX,
    files: int = FILES, visits: int = VISITS, block_rows: int = BLOCK_ROWS, rerank: int = RERANK, looks: int = LOOKS,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest rows of each row that ``queries`` holds for."""
    taken = df.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    taken = taken.where("vec_id is not null")
    if taken.where("asks").isEmpty():
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = choose_pivots(taken, pivots)
    leading = chosen[:files]
    filed = taken.mapInPandas(partial(_filed, pivots=leading), "vec_id long, vector array<double>, asks boolean, width int, file int")
    counts: dict[int, np.ndarray] = {}
    for r in filed.groupBy("width", "file").count().collect():  # at most files x widths rows
        counts.setdefault(r["width"], np.zeros(len(leading), np.int64))[r["file"]] = r["count"]
    layouts = {w: layout(n, block_rows) for w, n in counts.items()}
    places = [(w, f, int(of.first[f]), int(of.count[f])) for w, of in layouts.items() for f in range(len(leading)) if of.rows[f]]
    placed = df.sparkSession.createDataFrame(places, "width int, file int, first int, blocks int")
    index = filed.join(F.broadcast(placed), ["width", "file"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks"))).cast("int"))
    ask = taken.where("asks").select("vec_id", "vector").mapInPandas(partial(_visiting, pivots=leading, layouts=layouts, visits=visits, k=k, looks=looks), "vec_id long, vector array<double>, width int, block int, visits array<int>")
    answer = partial(_answered, pivots=chosen, length=min(length, len(chosen)), k=k, rerank=rerank)
    columns = index.select("vec_id", "vector", "width", "file", "block")
    found = columns.groupBy("width", "block").cogroup(ask.groupBy("width", "block")).applyInPandas(lambda left, right: answer(left, right), SHAPE)
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
