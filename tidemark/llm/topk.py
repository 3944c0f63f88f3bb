"""Exact top-k by inner product: dual-tree search over cover trees.

Candidates go to the nearest of a bounded number of pivots and from there to blocks of about CAND_ROWS rows, queries likewise
to groups of about QUERY_ROWS. A query's kth score among a bounded sample of candidates is a floor under its final one.
A group and a block whose covering radii allow no inner product up to the group's lowest floor are pruned before any
row is sent; for each pair that stays both sides are indexed by a cover tree and searched together from the floors on, and
pairs of nodes are pruned by their covering radii against the worst kth score of the node's queries. Blocks' best rows
are merged by a window over the query, which holds at most k + 1 rows for each block.

The sample (SEEDS rows by a hash) and the pivots (MAX_PIVOTS) only speed the search; results are exact for any. Null vectors and
vectors with null or non-finite components take no part; vectors of unlike length score only among themselves; rows
of a repeated id are rows of their own, as queries and as candidates, and a query leaves out one row of its id and
score, its own; ties go to the smaller id; empty tables give no rows; other columns are not read. Products of components that
doubles do not hold exactly are taken in whole numbers; scores beyond 64 bits are held at the ends of the range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.storage import saved

QUERY_ROWS, CAND_ROWS, LEAF, SEEDS, MAX_PIVOTS, FEW = 8192, 8192, 64, 2048, 256, 64
EXACT, LONG = 2.0**53, 2**63 - 1


class Node:
    """A cover-tree node: all rows within radius of the centre; children's centres are further than half of it from one another
    and their rows within that half. Rows that no FEW centres cover by half stay together in a leaf."""

    __slots__ = ("centre", "children", "length", "radius", "rows")

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.centre, self.rows, self.children = x[rows[0]], rows, []
        d = np.sqrt(((x[rows] - self.centre) ** 2).sum(1))
        self.radius, self.length = float(d.max()), float(np.linalg.norm(self.centre))
        if len(rows) > LEAF and self.radius > 0:
            centres, near, best = [0], np.zeros(len(rows), int), d.copy()
            while best.max() > self.radius / 2:
                if len(centres) % FEW == 0 and (best <= self.radius / 2).mean() < 0.5 * len(centres) / FEW or len(centres) * LEAF > 4 * len(rows):
                    return
                c = int(best.argmax())
                dc = np.sqrt(((x[rows] - x[rows[c]]) ** 2).sum(1))
                near[dc < best] = len(centres)
                best = np.minimum(best, dc)
                centres.append(c)
            for i, c in enumerate(centres):
                own = rows[near == i]
                self.children.append(Node(x, np.concatenate([[rows[c]], own[own != rows[c]]])))


def search(q: np.ndarray, floor: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int):
    """Best scores and candidate ids (row by row, -inf where there are fewer than k) at or above each query row's floor."""
    best_s = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    bar = floor.copy()

    def visit(a: Node, b: Node) -> None:
        top = a.centre @ b.centre + a.radius * b.length + b.radius * a.length + a.radius * b.radius
        if top < bar[a.rows].min() - 1e-6 * max(1.0, abs(top)):
            return
        if a.children and (a.radius >= b.radius or not b.children):
            for c in a.children:
                visit(c, b)
        elif b.children:
            for c in sorted(b.children, key=lambda c: -(a.centre @ c.centre)):
                visit(a, c)
        else:
            for first in range(0, len(b.rows), 2048):
                part = b.rows[first : first + 2048]
                s = q[a.rows] @ p[part].T
                hit = s >= bar[a.rows][:, None]
                for r in np.nonzero(hit.any(1))[0].tolist():
                    row, own = a.rows[r], np.nonzero(hit[r])[0]
                    all_s, all_i = np.concatenate([best_s[row], s[r, own]]), np.concatenate([best_i[row], p_ids[part[own]]])
                    order = np.lexsort((all_i, -all_s))[:k]
                    best_s[row], best_i[row] = all_s[order], all_i[order]
                    bar[row] = max(bar[row], best_s[row, k - 1])

    visit(Node(q, np.arange(len(q))), Node(p, np.arange(len(p))))
    return best_s, best_i


def search_whole(q, p, p_ids: np.ndarray, k: int):
    """All best scores in whole numbers of any size."""
    out = []
    for row in q:
        s = [sum(int(a) * int(b) for a, b in zip(row, x, strict=True)) for x in p]
        out.append(sorted((-v, int(i)) for v, i in zip(s, p_ids, strict=True))[:k])
    return out


def too_large(q: np.ndarray, p: np.ndarray) -> bool:
    return q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) > EXACT


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other rows by integer inner product."""

    def ready(df: DataFrame, name: str) -> DataFrame:
        v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
        ok = F.col(vec_col).isNotNull() & ~F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        return df.filter(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(name), v.alias("v"), F.size(vec_col).alias("dim"))

    cand, want = ready(vectors, "vec_id"), ready(queries, "query_id")
    spark = cand.sparkSession
    seeds = [(r.vec_id, r.v) for r in cand.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SEEDS).collect()]
    n, m = cand.count(), want.count()
    blocks, groups = min(MAX_PIVOTS, max(1, -(-n // CAND_ROWS))), min(MAX_PIVOTS, max(1, -(-m // QUERY_ROWS)))
    by_dim: dict[int, np.ndarray] = {d: np.array([v for _, v in seeds if len(v) == d]) for d in {len(v) for _, v in seeds}}

    def place(of: int, name: str):
        """Nearest pivot and distance to it, and the floor under the final kth score."""

        def each(frames):
            for f in frames:
                cell, dist, low = np.full(len(f), -1), np.full(len(f), np.inf), np.full(len(f), -np.inf)
                for d, at in f.groupby("dim").indices.items():
                    if d and d in by_dim:
                        x, near = np.stack(f["v"].to_numpy()[at]), by_dim[d][:of]
                        gap = np.sqrt(np.maximum(((x[:, None, :] - near[None]) ** 2).sum(2), 0)) if len(x) * len(near) * d < 4_000_000 else np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in near], 1)
                        cell[at], dist[at] = gap.argmin(1), gap.min(1)
                        if name == "query_id" and len(by_dim[d]) > k and not too_large(x, by_dim[d]):
                            low[at] = np.partition(x @ by_dim[d].T, -k - 1, axis=1)[:, -k - 1]
                yield f.assign(cell=cell.astype("int32"), dist=dist, low=low)

        return each

    kept = lambda df, of, name: saved(df.mapInPandas(place(of, name), f"{name} long, v array<double>, dim int, cell int, dist double, low double")).withColumn("n", F.monotonically_increasing_id())
    cells = lambda df, size: df.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"), F.max("dist").alias("radius"), F.min("low").alias("low"))
    cand, want = kept(cand, blocks, "vec_id"), kept(want, groups, "query_id")
    right, left = saved(cells(cand, CAND_ROWS)), saved(cells(want, QUERY_ROWS))
    # inner products of the pivots: at most MAX_PIVOTS squared for each of the lengths among SEEDS rows
    dots = [(int(d), g, b, float(x[g] @ x[b]), float(np.linalg.norm(x[g])), float(np.linalg.norm(x[b]))) for d, x in by_dim.items() if d for g in range(min(groups, len(x))) for b in range(min(blocks, len(x)))]
    dots = spark.createDataFrame(dots, "dim int, g int, b int, dot double, g_length double, b_length double")
    pairs = left.select("dim", F.col("cell").alias("g"), F.col("radius").alias("g_radius"), "low", F.col("parts").alias("g_parts")).join(right.select("dim", F.col("cell").alias("b"), F.col("radius").alias("b_radius"), F.col("parts").alias("b_parts")), "dim").join(dots, ["dim", "g", "b"], "left")
    top = F.col("dot") + F.col("g_radius") * F.col("b_length") + F.col("b_radius") * F.col("g_length") + F.col("g_radius") * F.col("b_radius")
    pairs = saved(pairs.filter(top.isNull() | (top >= F.col("low") - 1e-6 * F.greatest(F.lit(1.0), F.abs(top)))))
    deal = lambda parts: F.pmod(F.xxhash64("n"), F.col(parts)).cast("int")
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    a = want.withColumnRenamed("cell", "g").join(pairs.select("dim", "g", "b", "g_parts", "b_parts"), ["dim", "g"])
    a = a.withColumn("gp", deal("g_parts")).withColumn("bp", spread("b_parts")).select("dim", "g", "gp", "b", "bp", "n", "query_id", "v", "low")
    z = cand.withColumnRenamed("cell", "b").join(pairs.select("dim", "g", "b", "g_parts", "b_parts"), ["dim", "b"])
    z = z.withColumn("bp", deal("b_parts")).withColumn("gp", spread("g_parts")).select("dim", "g", "gp", "b", "bp", "vec_id", "v")

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(a) and len(b):
            q, p, ids = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), b["vec_id"].to_numpy()
            if not q.shape[1]:
                q, p = np.zeros((len(q), 1)), np.zeros((len(p), 1))
            if too_large(q, p) or too_large(q, q):
                found = [[(-s, i) for s, i in own] for own in search_whole(q, p, ids, k + 1)]
                mine = [sum(int(x) ** 2 for x in row) for row in q]
            else:
                s, i = search(q, a["low"].to_numpy(), p, ids, k + 1)
                found = [[(int(x), int(y)) for x, y in zip(*own, strict=True) if x != -np.inf] for own in zip(s, i, strict=True)]
                mine = (q * q).sum(1).astype("int64").tolist()
            for n, query_id, own, self_score in zip(a["n"], a["query_id"], found, mine, strict=True):
                rows.extend((n, query_id, i, max(min(s, LONG), -LONG), i == query_id and s == self_score) for s, i in own)
        return pd.DataFrame(rows, columns=["n", "query_id", "vec_id", "score", "own"])

    key = ["dim", "g", "gp", "b", "bp"]
    found = a.groupBy(*key).cogroup(z.groupBy(*key)).applyInPandas(pair, "n long, query_id long, vec_id long, score long, own boolean")
    w = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    first = F.col("own") & (F.sum(F.col("own").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    found = found.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= k + 1).withColumn("_own", first).filter(~F.col("_own"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(v, v.filter(F.col("vec_id") % 50 == 0))


ORACLE = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where embedding is not null),
 s as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.e, b.e) as bigint) as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
 select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5"""
