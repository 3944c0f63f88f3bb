"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Symbols are words. In texts that hold LOOSE of an item's rare words together, a word of NEAR_LETTERS letters or
more that is no word of the benchmark but one letter away from some counts as the first of these, so that changed letters
do not hide a passage. An item and a window of its length leak when
their edit distance is at most a fifth of the item's symbols. A window of the item's length and slack that holds too few
of the item's rare words cannot leak and is passed over (each rare word that is missing costs an edit). The
rest are embedded by random walks, WALKS independent ones; REPEATS samples of BITS positions are looked up among the items'
samples, and each hit is verified by the exact edit distance of the item to any stretch of the window's neighbourhood.

At distance 0 recall is 1; at the largest allowed distance it is measured in the tests. Items go in blocks of ITEM_BLOCK, each a
pass over the texts; a block's items are in the driver and in every task.

Null and empty texts and items match nothing; items of one word match equal words; repeated rows each give their rows, null
ids too; of repeated items each id gives rows; empty tables give none; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

RATE, BITS, WALKS, REPEATS, ITEM_BLOCK, TEXTS = 0.2, 4, 10, 40, 5000, 1500
NEAR_LETTERS, LOOSE, NEAR_SEEN = 5, 0.6, 50_000  # the last: answers kept, the rest are worked out again


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def nearest(items: np.ndarray, texts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of rows the least edit distance of the item to a stretch of the text, and where the first such stretch ends.

    A row's least value never falls from one item word to the next, so pairs beyond limit are
    left as soon as they pass it; their distance reads limit + 1. Zeros after a text match nothing."""
    pairs, n = items.shape
    width = texts.shape[1]
    dist, end = np.full(pairs, limit + 1, np.int64), np.zeros(pairs, np.int64)
    steps = np.arange(width + 1, dtype=np.int32)[:, None]
    for first in range(0, pairs, 1024):
        at = np.arange(first, min(first + 1024, pairs))
        item, text = items[at].T, np.ascontiguousarray(texts[at].T)
        row = np.zeros((width + 1, len(at)), np.int32)
        for i in range(n):
            new = np.empty_like(row)
            new[0] = i + 1
            np.minimum(row[:-1] + (text != item[i]), row[1:] + 1, out=new[1:])
            new -= steps
            np.minimum.accumulate(new, axis=0, out=new)
            new += steps
            row = new
            if i % 4 == 3 or i == n - 1:
                on = row.min(axis=0) <= limit
                if not on.all():
                    at, row, item, text = at[on], row[:, on], item[:, on], text[:, on]
                if not len(at):
                    break
        if len(at):
            dist[at], end[at] = row.min(axis=0), row.argmin(axis=0)
    return dist, end


def shorter(word: bytes) -> set[bytes]:
    """A word and its forms with one letter left out."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether one letter inserted, left out or changed makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return len(b) - len(a) < 2 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


class Index:
    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        df = Counter(x for _, w in split for x in set(w))
        limit = max(2, 0.03 * len(split))
        self.ids = {x: n for n, x in enumerate(sorted(df), 1)}
        self.near: dict[bytes, int] = {}
        self.near_seen: dict[bytes, int] = {}
        for x, n in self.ids.items():
            if len(x) >= NEAR_LETTERS - 1:
                for form in shorter(x):
                    self.near[form] = min(n, self.near.get(form, n))
        self.spelled = [b""] + sorted(df)
        self.rare = np.zeros(len(self.ids) + 1, bool)
        for x, n in self.ids.items():
            self.rare[n] = df[x] <= limit
        rng = np.random.default_rng(11)
        self.by_len: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, w in split:
            self.by_len[len(w)].append((i, np.array([self.ids[x] for x in w])))
        flat = [(i, s) for n in sorted(self.by_len) for i, s in self.by_len[n]]
        self.size = np.array([len(s) for _, s in flat], np.int64)
        self.slack = (RATE * self.size + 1e-9).astype(np.int64)
        self.need = np.array([int(self.rare[s].sum()) for _, s in flat], np.int64) - self.slack
        self.every = sorted(set(self.size[self.need <= 0].tolist()))
        holds = sorted({(int(x), k) for k, (_, s) in enumerate(flat) for x in s if self.rare[x]})
        self.owner = np.array([k for _, k in holds], np.int64)
        self.start = np.searchsorted(np.array([x for x, _ in holds]), np.arange(len(self.ids) + 2))
        self.walk, self.pick, self.table = {}, {}, {}
        for n, own in self.by_len.items():
            self.walk[n] = rng.integers(1, 2**40, (WALKS, 3 * n)) | 1
            self.pick[n] = np.stack([np.sort(rng.choice(3 * n, min(BITS, 3 * n), replace=False)) for _ in range(REPEATS)])
            keys = self.samples(np.stack([s for _, s in own]), n)
            known, which = np.unique(keys.ravel(), return_inverse=True)
            holds = np.unique(np.stack([which.ravel(), np.repeat(np.arange(len(own)), REPEATS)]), axis=1)
            self.table[n] = known, np.searchsorted(holds[0], np.arange(len(known) + 1)), holds[1]

    def samples(self, x: np.ndarray, n: int) -> np.ndarray:
        """Hash of each repeat's number and sampled positions for each row of symbols; all walks step together."""
        rows = len(x)
        flat = np.hstack([x + 1, np.zeros((rows, 1), np.int64)]).ravel()
        at = np.tile(np.arange(rows) * (n + 1), (WALKS, 1))
        taken, walked = set(self.pick[n].ravel().tolist()), {}
        for t in range(max(taken) + 1):
            c = flat.take(at)
            if t in taken:
                walked[t] = c
            at += (c * self.walk[n][:, t, None] >> 37) & 1  # the end, 0, keeps its place
        out = np.tile(np.arange(REPEATS, dtype=np.int64), (rows, 1))
        for r, picked in enumerate(self.pick[n].tolist()):
            for p in picked:
                out[:, r] = out[:, r] * 1_000_003 + walked[p][r % WALKS] + 7
        return out

    def found_by(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Distinct (row, number of an item of n words) that share a sample."""
        known, start, owner = self.table[n]
        spot = np.minimum(np.searchsorted(known, keys.ravel()), len(known) - 1)
        hit = np.nonzero(known[spot] == keys.ravel())[0]
        row, spot = hit // REPEATS, spot[hit]
        many = start[spot + 1] - start[spot]
        item = owner[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[spot], many)]
        return np.unique(np.stack([np.repeat(row, many), item], axis=1), axis=0)

    def near_word(self, word: bytes) -> int:
        """The number of the first benchmark word that is a letter away, or 0."""
        if len(word) < NEAR_LETTERS:
            return 0
        n = self.near_seen.get(word)
        if n is None:
            n = min((n for n in map(self.near.get, shorter(word)) if n and one_apart(self.spelled[n], word)), default=0)
            if len(self.near_seen) < NEAR_SEEN and len(word) < 40:
                self.near_seen[word] = n
        return n

    def symbols(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words, none where no item can be; words with changed letters are looked up where LOOSE of an item's rare words are together."""
        split, get = words(text), self.ids.get
        s = np.array([get(w, 0) for w in split], np.int64)
        if not s.any() or not self.windows(s, LOOSE):
            return s[:0]
        for k in np.nonzero(s == 0)[0].tolist():
            s[k] = self.near_word(split[k])
        return s

    def windows(self, s: np.ndarray, share: float = 1.0) -> dict[int, np.ndarray]:
        """Starts of windows, by length, that hold enough rare words of one item; items without enough rare words take every window.

        share: where it asks for fewer, this share of the item's rare words is enough."""
        at = np.nonzero(self.rare[s])[0]
        lo, hi = self.start[s[at]], self.start[s[at] + 1]
        n_own = hi - lo
        pos = np.repeat(at, n_own)
        which = self.owner[np.arange(n_own.sum()) - np.repeat(np.cumsum(n_own) - n_own, n_own) + np.repeat(lo, n_own)]
        found: dict[int, set[int]] = defaultdict(set)
        if len(pos):
            order = np.lexsort((pos, which))
            pos, which = pos[order], which[order]
            least = np.maximum(np.minimum(self.need, np.ceil(share * (self.need + self.slack)).astype(np.int64)), 1)[which]
            end = np.minimum(np.arange(len(pos)) + least - 1, len(pos) - 1)
            width = self.size[which] + self.slack[which]
            ok = (which[end] == which) & (end - np.arange(len(pos)) == least - 1) & (pos[end] - pos < width)
            for k in np.nonzero(ok)[0].tolist():
                found[int(self.size[which[k]])].update(range(max(0, int(pos[end[k]] - width[k]) + 1), int(pos[k]) + 1))
        out = {n: np.array(sorted(x for x in own if x <= len(s) - n) or [0], np.int64) for n, own in found.items()}
        return out | {n: np.arange(max(1, len(s) - n + 1)) for n in self.every}

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, first word) of each item that leaks into a text."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """scan() of many texts; windows of one length are embedded together."""
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        symbols: dict[int, np.ndarray] = {}
        todo: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for d, text in enumerate(texts):
            s = self.symbols(text)
            if len(s):
                for n, at in self.windows(s).items():
                    symbols[d] = s
                    todo[n].append((d, at))
        for n, groups in todo.items():
            docs = np.repeat([d for d, _ in groups], [len(at) for _, at in groups])
            starts = np.concatenate([at for _, at in groups])
            own, pad = self.by_len[n], int(RATE * n + 1e-9)
            for i in range(0, len(starts), 1024):
                part, doc = starts[i : i + 1024], docs[i : i + 1024]
                x = np.zeros((len(part), n), np.int64)
                for k, (d, p) in enumerate(zip(doc.tolist(), part.tolist(), strict=True)):
                    got = symbols[d][p : p + n]
                    x[k, : len(got)] = got
                pairs = self.found_by(self.samples(x, n), n)
                for j in range(0, len(pairs), 4096):
                    rows, which = pairs[j : j + 4096].T
                    wanted, near = np.stack([own[m][1] for m in which.tolist()]), np.zeros((len(rows), n + 2 * pad), np.int64)
                    starts_at = np.maximum(part[rows] - pad, 0)
                    for k, (d, lo, p) in enumerate(zip(doc[rows].tolist(), starts_at.tolist(), part[rows].tolist(), strict=True)):
                        got = symbols[d][lo : p + n + pad]
                        near[k, : len(got)] = got
                    dist, end = nearest(wanted, near, pad)
                    for k in np.nonzero(dist <= pad)[0].tolist():
                        d, item = int(doc[rows[k]]), own[which[k]][0]
                        found = (int(dist[k]), max(0, int(starts_at[k] + end[k]) - n))
                        if found < best[d].get(item, (n + 1, 0)):
                            best[d][item] = found
        return [[(i, d, p) for i, (d, p) in sorted(b.items())] for b in best]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance and first word for each item that leaks into a document."""
    whole = items.filter("text is not null and item_id is not null")
    blocks = max(1, -(-whole.count() // ITEM_BLOCK))
    kind, item_kind = (dict(df.dtypes)[c] for df, c in ((docs, "doc_id"), (items, "item_id")))
    src, out = docs.select("doc_id", "text"), None
    for b in range(blocks):
        rows = whole.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").collect()
        block = sorted((r[0], r[1]) for r in rows)

        def each(batches, block=block):
            index = Index(block)
            for batch in batches:
                for first in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(first, TEXTS)
                    got = [(row, *x) for row, found in enumerate(index.scan_all(part.column(1).to_pylist())) for x in found]
                    ids = part.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([g[1] for g in got]) if got else pa.array([], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())], names=["doc_id", "item_id", "distance", "first_word"])

        part = src.mapInArrow(each, f"doc_id {kind}, item_id {item_kind}, distance long, first_word long")
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
