"""N-gram Jaccard join by count vectors in R-trees.

A document is its set of distinct word shingles. Sets are compared by classes of sizes: linked sizes are in one class, or in
neighbouring ones, and a set takes part in its own class and the one below. In a class, hashing deals a set's shingles into
groups. Two sets with Jaccard j differ in at most (1-j)/j of the smaller size, so of more groups than that one is alike in
both; a group's content is a cell key. Only a set's fullest groups are keys, those of the largest least count that more of its
groups reach than two linked sets can differ in: of two linked sets the one with the higher least count has an untouched
group among its keys, which is a key of the other as well. A set with fewer filled groups than that is dealt again by another
hash, and after ROUNDS such deals takes one key that all such sets share, so the equality join is without loss.

Sets that share cells of a class, directly or through others, form a block of work. In it, cell by cell, the shingles' counts
in DIMS hashed groups are points of an R-tree over the cell's sets, a node's corners bound the overlap by summed
coordinate minima, and surviving pairs are verified on their shingles. Links that would join what is joined already are
not verified again.

Equal sets collapse before any pair is formed. Null and empty texts have empty sets and link with nothing, not even with one
another; texts with fewer words than a shingle are one shingle; repeated rows link, rows of one id with unlike texts are rows of
their own with that id; null ids stay null, and such a row links only where a row with an id has an equal set; an empty table
gives none; other columns are not read. Large blocks are cut into parts, and each pair of parts is its own group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.storage import saved

DIMS, FANOUT, PART_ROWS, ROUNDS, REFUSED, HASHED_BYTES = 64, 32, 3000, 16, 1_000_000, 1 << 16
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= M2
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


MIXED = mix(np.arange(1, 257, dtype=np.uint64))
GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lowered bytes in order, and where each word starts."""
    b = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = GAP[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out, starts
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, own = starts[order], np.zeros(len(starts), np.uint64)
    longer = len(starts) - np.cumsum(np.bincount(np.minimum(lengths, 24), minlength=25))  # words of more than i bytes; they come first
    for i in range(int(min(lengths.max(), 24))):
        n = int(longer[i]) if i < 24 else 0
        own[:n] *= BASE
        own[:n] += MIXED[b[at[:n] + i]]
    out[order] = own
    for j in np.flatnonzero(lengths > 24):
        h = int(out[j])
        for x in raw[starts[j] + 24 : ends[j]]:
            h = (h * int(BASE) + x + 1) & 0xFFFFFFFFFFFFFFFF
        out[j] = h
    return mix(out + lengths.astype(np.uint64)), starts


def word_hashes(text: str | None, table: bytes | None = None) -> np.ndarray:
    """Hashes of the words of a text in order, ASCII letters lowered, parted by ASCII white space; table maps bytes first."""
    raw = lowered(text)
    return hashed(raw.translate(table) if table else raw)[0]


def windows(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    h = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for i in range(k):
        h = mix(h * M1 + w[i : i + len(h)])
    return h


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingles(text: str | None, n: int) -> np.ndarray:
    return next(all_shingles([text], n))


def all_shingles(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    """The shingles of each text; short texts are hashed together."""

    def some(raws: list[bytes]) -> Iterator[np.ndarray]:
        w, starts = hashed(b" ".join(raws))
        first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)])).tolist()
        h = windows(w, n)
        for a, z in zip(first[:-1], first[1:], strict=True):
            yield distinct(h[a : z - n + 1]) if z - a >= n else windows(w[a:z], z - a) if z > a else w[:0]

    raws, size = [], 0
    for t in texts:
        raws.append(lowered(t))
        size += len(raws[-1])
        if size > HASHED_BYTES:
            yield from some(raws)
            raws, size = [], 0
    if raws:
        yield from some(raws)


def digest(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0


def size_class(n: int, j: float) -> int:
    """Classes of sizes by powers of 1/j, so that linked sizes are in the same or the next class."""
    return int(np.floor(np.log(n) / np.log(1 / j) + 1e-9))


def most_apart(n: float, j: float) -> int:
    """Most shingles by which a set of n can differ from a set that it links with."""
    return int((1 - j) / j * n + 1e-9)


@lru_cache(maxsize=4096)
def n_groups(top: int, j: float) -> int:
    """Groups for sets of up to top shingles: so many that the groups beyond those in which linked sets can differ are as full as can be."""
    need = most_apart(top, j) + 1
    best, d = (0, 0, need), need
    while d <= max(need, top):
        mean, reached, term, g = top / d, d * (1 - exp(-top / d)), exp(-top / d), 1
        found = None
        while reached >= need + 0.5 * reached**0.5 * (reached < d - 1e-6) or g == 1 and d == need:
            found = (g, -d, d)
            term *= mean / g
            reached -= d * term
            g += 1
            if reached < 0.5:
                break
        if found and found > best:
            best = found
        d += max(1, d // 50)
    return best[2]


def class_cells(s: np.ndarray, j: float, c: int) -> np.ndarray:
    """Cell keys of a set in a class: content hashes of its fullest groups.

    The rounds of two linked sets end by their own counts. In the earlier end's round both have dealt, and the one that
    goes on takes all its filled groups; if neither ends, both take the last key."""
    top = int(np.ceil(j ** -(c + 1))) + 1  # above the sizes of class c, the smaller of a pair
    d, apart, out = n_groups(top, j), most_apart(min(len(s), top), j), []
    mixed = mix(s)
    for r in range(ROUNDS):
        g = (mix(s + np.uint64(7 + 1000 * r)) % np.uint64(d)).astype(np.int64)
        total = np.zeros(d, np.uint64)
        np.add.at(total, g, mixed)
        count = np.bincount(g, minlength=d)
        enough = (count > 0).sum() > apart
        low = max(1, int(np.partition(count, d - apart - 1)[d - apart - 1])) if enough else 1
        on = np.nonzero(count >= low)[0]
        out.append(mix(mix(total[on] + on.astype(np.uint64) * M1) + count[on].astype(np.uint64) + np.uint64(c * 1_000_003 + r * 1_000_000_007)))
        if enough:
            break
    else:
        out.append(mix(np.array([c], np.uint64) * M2 + np.uint64(5)))
    return np.concatenate(out).astype(np.int64)


def classes(n: int, j: float) -> list[int]:
    """The classes that a set of n shingles takes part in: its own, and that of the smallest sets that it links with."""
    return sorted({size_class(n, j), size_class(max(1, int(np.ceil(j * n - 1e-9))), j)})


def cells(s: np.ndarray, j: float) -> np.ndarray:
    return np.concatenate([class_cells(s, j, c) for c in classes(len(s), j)])


def vertex(node: int, c: int) -> int:
    """A set as a member of a class."""
    return int(mix(np.array([(node + (c + 1) * int(M2)) & 0xFFFFFFFFFFFFFFFF], np.uint64)).astype(np.int64)[0])


def counts(s: np.ndarray) -> np.ndarray:
    return np.bincount((s % np.uint64(DIMS)).astype(np.int64), minlength=DIMS).astype(np.int32)


def join_block(sets: list[np.ndarray], j: float, c: int) -> np.ndarray:
    """Component index of each set: in each cell of the class an R-tree search by each set in turn, among sets not yet joined to it."""
    n = len(sets)
    label = np.arange(n)
    size = np.array([len(s) for s in sets])
    point = np.stack([counts(s) for s in sets])
    keys = [class_cells(s, j, c) for s in sets]
    cell, member = np.concatenate(keys), np.repeat(np.arange(n), [len(k) for k in keys])
    order = np.lexsort((size[member], cell))
    cell, member = cell[order], member[order]
    refused: set[tuple[int, int]] = set()

    def one_cell(order: np.ndarray) -> None:
        nodes = [order[i : i + FANOUT] for i in range(0, len(order), FANOUT)]
        corner = np.stack([point[x].max(0) for x in nodes])
        smallest, largest = size[[x[0] for x in nodes]], size[[x[-1] for x in nodes]]
        for k, p in enumerate(order.tolist()):
            ok = (smallest <= size[p] / j) & (largest >= size[p] * j) & (np.arange(len(nodes)) >= k // FANOUT)
            ok[ok] = np.minimum(corner[ok], point[p]).sum(1) * (1 + j) >= j * (size[p] + smallest[ok]) - 1e-6
            rows = np.concatenate([nodes[i] for i in np.nonzero(ok)[0]]) if ok.any() else order[:0]
            rows = rows[label[rows] != label[p]]
            rows = rows[np.minimum(point[rows], point[p]).sum(1) * (1 + j) >= j * (size[p] + size[rows]) - 1e-6]
            for r in rows.tolist():
                pair = (p, r) if p < r else (r, p)
                if label[r] != label[p] and pair not in refused:
                    both = len(np.intersect1d(sets[p], sets[r], assume_unique=True))
                    if 100 * both >= round(100 * j) * (size[p] + size[r] - both):
                        a, b = sorted((label[p], label[r]))
                        label[label == b] = a
                    else:
                        refused.add(pair)
                        if len(refused) > REFUSED:  # they are verified anew where they meet again
                            refused.clear()

    for own in np.split(member, np.nonzero(np.diff(cell))[0] + 1):
        if len(own) > 1 and (label[own] != label[own[0]]).any():
            one_cell(own)
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over edges (a, b).

    Each round points a node to its smallest neighbour, follows the pointers twice and contracts
    the edges, so that rounds shrink."""
    e = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    label = e.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    started = False
    while e.limit(1).count():
        near = saved(e.select(F.col("b").alias("node"), F.col("a").alias("c")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("c"))).groupBy("node").agg(F.min("c").alias("c")))
        hop = near.select(F.col("node").alias("c"), F.col("c").alias("d"))
        step = saved(near.join(hop, "c").select("node", F.col("d").alias("c")))
        if started:
            label = label.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("c", "component").alias("component"))
        else:
            label, started = step.withColumnRenamed("c", "component"), True
        label = saved(label)
        to_a, to_b = step.select(F.col("node").alias("a"), F.col("c").alias("x")), step.select(F.col("node").alias("b"), F.col("c").alias("y"))
        e = saved(e.join(to_a, "a").join(to_b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return label


def forest(cell: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct nodes, each one's root over shared cells, and the row of each root entry that stands for its cell."""
    ids, at = np.unique(node, return_inverse=True)
    order = np.argsort(cell, kind="stable")
    same = cell[order][1:] == cell[order][:-1]
    a, b = at[order][1:][same], at[order][:-1][same]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label], order[np.concatenate([[True], ~same])] if len(cell) else order


def shared_cells(src: DataFrame, n: int, j: float) -> DataFrame:
    """Edges (a, b) that join the members of a class which share a cell, directly or through others.

    Each batch of documents joins its own first and then holds a cell once, so a cell that
    many documents hold is small before the shuffle. Cells travel packed, by buckets of
    about a million, and a bucket gives a forest of edges."""
    chars = src.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // 10_000_000)

    def pack(frames):
        for f in frames:
            own = {}
            for s in all_shingles(f["text"], n):
                if len(s):
                    own.setdefault(digest(s), s)
            part = [(vertex(d, c), class_cells(s, j, c)) for d, s in own.items() for c in classes(len(s), j)]
            if not part:
                continue
            keys = [k for _, k in part]
            node = np.repeat(np.array([v for v, _ in part], np.int64), [len(k) for k in keys])
            cell = np.concatenate(keys)
            ids, root, first = forest(cell, node)
            up = root[np.searchsorted(ids, node[first])]
            low = ids != root  # a joined set and its root share a cell of their own
            tie = mix(root[low].astype(np.uint64) + np.uint64(11)).astype(np.int64)
            cell, node = np.concatenate([cell[first], tie, tie]), np.concatenate([up, ids[low], root[low]])
            bucket = cell % buckets
            order = np.lexsort((node, bucket))
            cell, node, bucket = cell[order], node[order], bucket[order]
            cuts = np.nonzero(np.diff(bucket))[0] + 1
            yield pd.DataFrame({
                "bucket": bucket[np.concatenate([[0], cuts])],
                "node": [x.tobytes() for x in np.split(node, cuts)],
                "cell": [x.tobytes() for x in np.split(cell, cuts)],
            })

    def join(f: pd.DataFrame) -> pd.DataFrame:
        ids, root, _ = forest(np.frombuffer(b"".join(f["cell"]), np.int64), np.frombuffer(b"".join(f["node"]), np.int64))
        low = ids != root
        return pd.DataFrame({"a": ids[low], "b": root[low]})

    packed = src.select("text").mapInPandas(pack, "bucket long, node binary, cell binary")
    return packed.groupBy("bucket").applyInPandas(join, "a long, b long")


def similar_join(docs: DataFrame, n: int = 3, j: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def profile(batches):
        for b in batches:
            own = list(all_shingles(b.column(1).to_pylist(), n))
            columns = [[len(s) for s in own], [digest(s) for s in own], [int(mix(s * M1 + np.uint64(3)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in own]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_shingles", "digest", "digest2"])

    def members(batches):
        for b in batches:
            rows = [(vertex(d, c), c, d, rep) for rep, d, size in zip(*(x.to_pylist() for x in b.columns), strict=True) for c in classes(size, j)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["node", "class", "digest", "rep"])

    prof = saved(src.mapInArrow(profile, "doc_id long, n_shingles long, digest long, digest2 long"))
    reps = saved(prof.filter("n_shingles > 0").groupBy("digest", "digest2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")))
    blocks = components(shared_cells(src, n, j))
    sets = reps.select("rep", "digest", "size").mapInArrow(members, "node long, class int, digest long, rep long")
    work = blocks.join(sets, "node").select(F.col("component").alias("block"), "class", F.col("digest").alias("node"), "rep")
    work = work.join(src, F.col("rep") == F.col("doc_id")).select("block", "class", "node", "text")
    parts = work.groupBy("block").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / PART_ROWS).cast("int"))
    work = work.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least("part", i).alias("p"), F.greatest("part", i).alias("q")))
    work = work.withColumn("pair", F.explode(others)).select("block", "pair.p", "pair.q", "class", "node", "text")

    def link(f: pd.DataFrame) -> pd.DataFrame:
        sets = {}
        for node, own in zip(f["node"], all_shingles(f["text"], n), strict=True):
            if digest(own) == node:  # rows of one id may have unlike texts
                sets[node] = own
        ids = np.array(sorted(sets), np.int64)
        lab = join_block([sets[i] for i in ids.tolist()], j, int(f["class"].iloc[0])) if len(ids) else ids
        low = pd.Series(ids).groupby(lab).transform("min").to_numpy()
        on = ids != low
        return pd.DataFrame({"a": ids[on], "b": low[on]})

    comp = components(saved(work.groupBy("block", "p", "q").applyInPandas(link, "a long, b long")))
    labelled = reps.join(comp, F.col("digest") == F.col("node"), "left").select("digest", "digest2", "rep", F.coalesce("component", "digest").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    labelled = labelled.join(smallest, "component").select("digest", "digest2", "component_id")
    return prof.join(labelled, ["digest", "digest2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
