"""Product codes of vectors: four codebooks of up to 256 whole-numbered entries, trained in four rounds.

Each component x becomes floor(1024 * x). The distinct parts of each position, with the number of rows that hold each, are
dealt by range and sorted once, so that each task holds a lexicographic trie of parts. A round walks the tries depth first: a node
holds the distances of its prefix to all entries, summed over the prefix's dimensions, and hands them to its children, which add their own
dimension; leaves take the nearest entry (ties to the lower one) and add their components, times their number of rows, to its
sum. Only sums by entry leave a task, and only the codebooks (4 * 256 entries, whatever the number of rows) reach the driver.
Last, each row's parts are coded by tries over the distinct parts of a batch.

Rows whose vector is null or holds null or non-finite components take no part; where lengths differ or do not divide by four,
vectors count as followed by zeros; rows of equal ids are rows of their own, ordered by their components; null ids come last; null labels are
one label; fewer than 256 rows make smaller codebooks; an empty table gives no rows; other columns are not read. Components of any
finite size are held exactly; errors beyond 64 bits are held at the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.storage import saved

PARTS, ENTRIES, SCALE, ROUNDS, LEAVES = 4, 256, 1024, 4, 4096
LONG = 2**63 - 1


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each row; rows are distinct, in lexicographic order and of the book's type."""
    n, width = x.shape
    which, far = np.zeros(n, "int64"), np.zeros(n, x.dtype)

    def leaves(rows: np.ndarray, depth: int, held: np.ndarray) -> None:
        for a in range(0, len(rows), LEAVES):
            r = rows[a : a + LEAVES]
            d = held[a : a + LEAVES]
            if depth < width:  # a leaf alone below its node: its further dimensions at once
                y, c = x[r, depth:], book[:, depth:]
                d = d + (y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)
            which[r] = d.argmin(1)
            far[r] = d[np.arange(len(r)), which[r]]

    todo = [(0, n, 0, np.zeros(len(book), x.dtype))] if n else []
    while todo:
        lo, hi, depth, held = todo.pop()
        if depth == width:
            leaves(np.arange(lo, hi), depth, np.broadcast_to(held, (hi - lo, len(book))))
            continue
        column = x[lo:hi, depth]
        first = np.concatenate([[0], np.nonzero(column[1:] != column[:-1])[0] + 1])
        size = np.diff(np.append(first, hi - lo))
        gap = column[first][:, None] - book[:, depth]
        below = held + gap * gap
        alone = size == 1
        leaves(lo + first[alone], depth + 1, below[alone])
        todo.extend((lo + f, lo + f + s, depth + 1, d) for f, s, d in zip(first[~alone].tolist(), size[~alone].tolist(), below[~alone], strict=True))
    return which, far


def ready(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label and whole-numbered components; doubles from 2^50 on are whole as they are."""
    scaled = lambda x: F.lit(float(SCALE)) * x.cast("double")
    whole = F.transform(F.col(vec_col), lambda x: F.when(F.abs(scaled(x)) < 2.0**50, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)) + F.lit(0.0))
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v"))


def padded(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors of up to PARTS * width components as rows of a matrix."""
    if all(len(v) == PARTS * width for v in rows):
        return np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, PARTS * width))
    out = np.zeros((len(rows), PARTS * width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def typed(x: np.ndarray, safe: bool) -> np.ndarray:
    """As doubles, where these hold every sum of squares exactly, else as Python's whole numbers."""
    return x if safe else np.frompyfunc(int, 1, 1)(x)


def books_of(entries: list[list[list[int]]], safe: bool) -> list[np.ndarray]:
    return [np.array(e, dtype="float64" if safe else object) for e in entries]


def train(parts: DataFrame, entries: list[list[list[int]]], width: int, safe: bool) -> list[list[list[int]]]:
    """One round: parts go to their nearest entries, and each used entry becomes the floor of its parts' mean."""
    spark = parts.sparkSession
    shared = spark.sparkContext.broadcast(entries)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = books_of(shared.value, safe)
        sums = [np.zeros((len(b), width), "int64" if safe else object) for b in books]
        counts = [np.zeros(len(b), "int64") for b in books]
        for f in frames:
            for k, own in f.groupby("part", sort=False):
                x, n = np.stack(own["x"].to_numpy()), own["n"].to_numpy()
                which, _ = nearest(typed(x, safe), books[k])
                whole = x.astype("int64") if safe else typed(x, safe)
                np.add.at(sums[k], which, whole * n[:, None])
                np.add.at(counts[k], which, n)
        rows = [(k, e, int(counts[k][e]), [str(v) for v in sums[k][e].tolist()]) for k in range(PARTS) for e in np.nonzero(counts[k])[0].tolist()]
        yield pd.DataFrame(rows, columns=["part", "entry", "n", "sums"])

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:  # a row for each task at most
        total, n = [sum(map(int, c)) for c in zip(*f["sums"], strict=True)], int(f["n"].sum())
        return pd.DataFrame([(*key, [str(t // n) for t in total])], columns=["part", "entry", "means"])

    sums = parts.mapInPandas(each, "part int, entry int, n long, sums array<string>")
    out = [[list(e) for e in book] for book in entries]
    for r in sums.groupBy("part", "entry").applyInPandas(add, "part int, entry int, means array<string>").collect():
        out[r.part][r.entry] = [int(m) for m in r.means]
    shared.destroy()
    return out


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """vec_id, label, code and error of each kept row, and the final codebooks: entries by part."""
    rows = ready(vectors, id_col, vec_col, label_col)
    spark = rows.sparkSession
    most = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).head()
    width, top = max(1, -(-(most["dim"] or 0) // PARTS)), most["top"] or 0.0
    safe = width * (2 * top) ** 2 < 2.0**53 and top < 2.0**25
    full = F.concat(F.col("v"), F.array_repeat(F.lit(0.0), F.lit(PARTS * width) - F.size("v")))
    seeds = padded(pd.Series([r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(ENTRIES).collect()], dtype=object), width)
    entries = [[[int(c) for c in v[k * width : (k + 1) * width]] for v in seeds.tolist()] for k in range(PARTS)]
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.slice(full, k * width + 1, width))).alias("part", "x")
    parts = saved(rows.select(cut).groupBy("part", "x").agg(F.count("*").alias("n")).repartitionByRange("part", "x").sortWithinPartitions("part", "x"))
    for _ in range(ROUNDS if len(seeds) else 0):
        entries = train(parts, entries, width, safe)
    shared = spark.sparkContext.broadcast(entries)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = books_of(shared.value, safe)
        for f in frames:
            v = padded(f["v"], width)
            which, far = np.zeros((len(f), PARTS), "int64"), np.zeros(len(f), object)
            for k in range(PARTS):
                x, back = np.unique(v[:, k * width : (k + 1) * width], axis=0, return_inverse=True)
                w, d = nearest(typed(x, safe), books[k])
                which[:, k] = w[back]
                far += typed(d, False)[back]
            code = ["".join(f"{e:02x}" for e in row) for row in which.tolist()]
            yield f[["vec_id", "label"]].assign(code=code, error=[min(e, LONG) for e in far])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInPandas(each, f"vec_id long, label {kind}, code string, error long"), entries


def report(vectors: DataFrame, **columns: str) -> DataFrame:
    coded, entries = encode(vectors, **columns)
    coded = saved(coded)
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select(F.col("label").alias("_label"), F.least("s", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    text = ",".join(str(c) for book in entries for e in book for c in e)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """The same with lists and joins, for vectors of one length."""
    gap = "cast(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    out = [
        "with v as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings"
        " where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "p as materialized (select vec_id, label, part, e[part * (len(e) // 4) + 1 : (part + 1) * (len(e) // 4)] as x from v cross join range(4) t(part))",
        "b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c from p where vec_id in (select vec_id from v order by vec_id limit 256))",
    ]
    for i in range(ROUNDS + 1):
        out.append(f"a{i} as materialized (select p.vec_id, p.label, p.part, p.x, min({gap} * 256 + b.entry) as best from p join b{i} b on p.part = b.part group by all)")
        if i < ROUNDS:
            out.append(f"u{i} as (select part, best % 256 as entry, x, unnest(range(1, len(x) + 1)) as j from a{i})")
            out.append(f"w{i} as (select part, entry, j, cast(floor(cast(sum(x[j]) as double) / count(*)) as bigint) as m from u{i} group by all)")
            out.append(f"m{i} as (select part, entry, list(m order by j) as c from w{i} group by all)")
            out.append(f"b{i + 1} as materialized (select b.part, b.entry, coalesce(m.c, b.c) as c from b{i} b left join m{i} m on b.part = m.part and b.entry = m.entry)")
    out.append(f"s as (select vec_id, any_value(label) as label, string_agg(printf('%02x', best % 256), '' order by part) as code, cast(sum(best // 256) as bigint) as error from a{ROUNDS} group by vec_id)")
    out.append(f"h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS})")
    return ", ".join(out) + " select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from s cross join h"


ORACLE = oracle()
