"""Exact search for the highest inner products with M-trees.

Vectors get one more component, chosen so that all have the same length; the nearest vectors in that
space are those of the highest inner product. Rows go to the nearest of a bounded set of routing
vectors, large groups are split, and each group becomes a tree of pages. A page has a pivot, a
covering radius, and every member's distance from the pivot. A query visits a tree's pages in order
of the least distance they can hold, stops when no page can hold a better one, and skips members
that the triangle inequality rules out by their stored distance. Scores are integer products, so
bounds only decide what is looked at; they carry slack for rounding.

Trees and blocks of queries meet in tasks: every query meets every tree once, and a task holds one
tree and one block, both of bounded size. Each returns at most ``k`` rows a query.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part.
A vector shorter than the longest is filled with zeros. A row is not its own candidate; rows of one
``vec_id`` are the same row. Equal scores go to the smaller id. A null id takes no part. An empty
table gives no rows. Other columns are ignored. Components must stay below 2**31 after scaling.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import settle

#: Vectors of a tree and of a page, queries of a block, and routing vectors at most.
TREE, PAGE, BLOCK, ROUTES = 4096, 64, 8192, 1024
SLACK = 1e-6


def scaled(embedding: Column, scale: float = 256.0) -> Column:
    """Components as integers, ``floor(scale * x)``."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, bad)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array([np.pad(x, (0, width - len(x))) for x in column], np.int64).reshape(-1, width)


def _lifted(vectors: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with the component that gives all of them the same length."""
    rest = np.sqrt(np.maximum(0.0, reach - (vectors.astype(np.float64) ** 2).sum(1)))
    return np.column_stack([vectors.astype(np.float64), rest])


def _routing(routes: np.ndarray, width: int, reach: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squares = (routes**2).sum(1)
        for batch in batches:
            points = _lifted(_matrix(batch["v"], width), reach)
            yield batch.assign(route=(squares - 2 * points @ routes.T).argmin(1).astype(np.int32))

    return run


def _pages(points: np.ndarray) -> list[np.ndarray]:
    """Rows of each page: halves by distance to two far members until a page holds few; equal rows are cut by count."""
    done, left = [], [np.arange(len(points))]
    while left:
        rows = left.pop()
        if len(rows) <= PAGE:
            done.append(rows)
            continue
        own = points[rows]
        a = own[np.linalg.norm(own - own[0], axis=1).argmax()]
        b = own[np.linalg.norm(own - a, axis=1).argmax()]
        order = np.argsort(np.linalg.norm(own - a, axis=1) - np.linalg.norm(own - b, axis=1), kind="stable")
        left += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def _building(width: int, reach: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        points = _lifted(_matrix(group["v"], width), reach)
        out = group.assign(page=np.int32(0), pivot=False, from_pivot=0.0)
        page, pivot, apart = np.zeros(len(group), np.int32), np.zeros(len(group), bool), np.zeros(len(group))
        for number, rows in enumerate(_pages(points)):
            middle = rows[np.linalg.norm(points[rows] - points[rows].mean(0), axis=1).argmin()]
            page[rows], pivot[middle] = number, True
            apart[rows] = np.linalg.norm(points[rows] - points[middle], axis=1)
        return out.assign(page=page, pivot=pivot, from_pivot=apart)[["tree", "page", "pivot", "from_pivot", "vec_id", "v"]]

    return run


class _Tree:
    """The pages of one group, as arrays."""

    def __init__(self, rows: pd.DataFrame, width: int, reach: float):
        rows = rows.sort_values(["page", "vec_id"], ignore_index=True)
        self.ids, self.vectors = rows["vec_id"].to_numpy(), _matrix(rows["v"], width)
        self.apart = rows["from_pivot"].to_numpy()
        self.starts = np.flatnonzero(np.r_[True, np.diff(rows["page"].to_numpy()) > 0])
        self.ends = np.append(self.starts[1:], len(rows))
        self.pivots = _lifted(self.vectors, reach)[rows["pivot"].to_numpy()]
        self.radii = np.maximum.reduceat(self.apart, self.starts)

    def search(self, query: np.ndarray, own: int, k: int, reach: float) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, -id)``; pages in order of the least distance they can hold."""
        away = np.linalg.norm(self.pivots - np.append(query.astype(np.float64), 0.0), axis=1)
        least = np.maximum(0.0, away - self.radii)
        length = float(query @ query) + reach
        best: list[tuple[int, int]] = []
        limit = np.inf
        for p in np.argsort(least, kind="stable").tolist():
            if least[p] > limit:
                break
            a, b = self.starts[p], self.ends[p]
            rows = np.arange(a, b)[np.abs(away[p] - self.apart[a:b]) <= limit]
            for score, i in zip((self.vectors[rows] @ query).tolist(), self.ids[rows].tolist()):
                if i != own and (len(best) < k or (score, -i) > best[0]):
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -i))
            if len(best) == k:
                limit = np.sqrt(max(0.0, length - 2 * best[0][0])) * (1 + SLACK) + SLACK * np.sqrt(length)
        return best


def _searching(width: int, reach: float, k: int):
    def run(tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tree) and len(queries):
            own = _Tree(tree, width, reach)
            for query_id, query in zip(queries["vec_id"].tolist(), _matrix(queries["v"], width)):
                out += [(query_id, -i, score) for score, i in own.search(query, query_id, k, reach)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vectors`` (``vec_id, embedding``) for each query row."""
    spark = vectors.sparkSession
    taken = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = settle(taken.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"), is_query.alias("asks")).dropDuplicates(["vec_id"]), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("reach"), F.sum(F.col("asks").cast("int")).alias("asked")).first()
    kind = "vec_id long, v array<long>, asks boolean"
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, reach = facts["width"], float(facts["reach"])
    wanted = min(ROUTES, -(-facts["n"] // TREE))
    chosen = rows.orderBy(F.xxhash64("vec_id")).limit(wanted).select("v").toPandas()
    routed = settle(rows.mapInPandas(_routing(_lifted(_matrix(chosen["v"], width), reach), width, reach), f"{kind}, route int"), "routed")
    sizes = {r["route"]: r["count"] for r in routed.groupBy("route").count().collect()}
    first, trees = {}, 0
    for route in sorted(sizes):
        first[route], trees = trees, trees + -(-sizes[route] // TREE)
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("route")]
    parts = table({r: -(-n // TREE) for r, n in sizes.items()})
    tree = (table(first) + F.pmod(F.xxhash64("vec_id"), parts)).cast("int")
    index = settle(
        routed.withColumn("tree", tree).groupBy("tree").applyInPandas(_building(width, reach), "tree int, page int, pivot boolean, from_pivot double, vec_id long, v array<long>"),
        "m-tree",
    )
    blocks = max(1, -(-(facts["asked"] or 0) // BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where("asks").select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), each(trees).alias("tree"))
    met = index.withColumn("block", each(blocks)).groupBy("tree", "block").cogroup(asked.groupBy("tree", "block"))
    found = met.applyInPandas(_searching(width, reach, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
