"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common character subsequences of length three with gaps, each weighted by DECAY to its span, over the
length of the strings. Strings are the words of a sentence, also without inner signs, and runs of three or more
fragments of one or two characters joined; inserted characters only lengthen a gap. Strings over LONGEST characters count by
their overlapping stretches, in fitting as in scoring. A sentence scores as its highest string and a document as its
highest sentence, so documents are bags: training starts from the labels of the sentences' documents and keeps, round by
round, the strings that carry a positive bag. Landmark weights fold into one table over subsequences, so a string costs
a few dozen table reads.

Fitting takes a bounded sample of labelled rows (MAX_BAGS toxic and twice as many clean ones, by a hash of the id) with all
their strings; scoring covers all texts whole. Null and empty texts score near 0; repeated rows and ties score alike; an
empty table gives no rows; without labelled toxic or clean rows every score is near 0; other columns, also ones
named like results, are not read by the query. Kept columns go through untouched, the score under the name asked for.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

DECAY, SPAN, SIGNS, LONGEST, LANDMARKS = 0.7, 6, 40, 24, 320
MAX_BAGS, REMEMBER, ROUNDS, CONTRAST = 700, 200_000, 5, 5.0
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
INNER = re.compile(r"[\W_]")
RUN = re.compile(r"(?<!\S)\S{1,2}(?:\s\S{1,2}){2,}(?!\S)")
EDGE = ".,;:!?\"'()[]{}*#$%&|"


def sign(c: int) -> int:
    """Letters 1..26, digits 27, accented letters 28..38, other signs 39."""
    return c - 96 if 97 <= c <= 122 else 27 if 48 <= c <= 57 else 39 if c < 128 else 28 + c % 11


TABLE = np.array([sign(c) for c in range(0x250)] + [39], np.int32)
NORM = [0.0] + [sum(max(0, n - b) * DECAY ** (2 * b + 2) for _, b in PAIRS) ** 0.5 for n in range(1, LONGEST + 1)]


def tokens(text: str | None) -> set[str]:
    """The distinct words of a text and its runs of fragments, as they stand."""
    low = (text or "").lower()
    return set(low.split()) | {m.group() for m in RUN.finditer(low)}


def forms(token: str) -> list[str]:
    """The strings of a token: without signs at its ends, and without any."""
    plain = token.strip(EDGE)
    if plain.isalnum():
        return [plain]
    return [x for x in {plain if len(plain.split()) < 2 else "", INNER.sub("", plain)} if x]


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def subsequences(words: list[str]):
    """(rows, codes, weights) by length of the words: the codes of a row's subsequences and their normalised weights."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, rows in by_length.items():
        if n < 3:
            continue
        for first in range(0, len(rows), 512):
            part = rows[first : first + 512]
            letters = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
            m = TABLE[np.minimum(letters, len(TABLE) - 1)].reshape(len(part), n)
            codes = [(m[:, : n - b] * SIGNS + m[:, a : n - b + a]) * SIGNS + m[:, b:] for a, b in PAIRS if b < n]
            weights = [np.full(n - b, DECAY ** (b + 1) / NORM[n], np.float32) for _, b in PAIRS if b < n]
            yield np.array(part), np.concatenate(codes, 1), np.concatenate(weights)


class Scorer:
    """A fitted table over subsequences with its offset and calibration."""

    def __init__(self, table: np.ndarray, offset: float, slope: float, shift: float):
        self.table, self.offset, self.slope, self.shift = table, offset, slope, shift
        self.known: dict[str, float] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """The machine's value of each string, of long ones the highest of their stretches."""
        split = [pieces(w) for w in words]
        flat = [p for ps in split for p in ps]
        f = np.full(len(flat), self.offset, np.float32)
        for rows, codes, weights in subsequences(flat):
            f[rows] += self.table[codes] @ weights
        return np.maximum.reduceat(f, np.cumsum([0] + [len(p) for p in split[:-1]])) if words else f

    def learn(self, new: list[str]) -> None:
        for first in range(0, len(new), 4096):
            part = new[first : first + 4096]
            split = [forms(t) for t in part]
            f = self.words([x for xs in split for x in xs]).tolist()
            at = 0
            for t, xs in zip(part, split, strict=True):
                self.known[t] = max(f[at : at + len(xs)], default=-2.0)
                at += len(xs)

    def score(self, texts: list[str | None]) -> np.ndarray:
        bags = [tokens(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.known.clear()
        self.learn([t for t in set().union(*bags) if t not in self.known])
        top = np.array([max(map(self.known.__getitem__, b), default=-2.0) for b in bags], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * (top - self.shift), -30, 30)))


def svm(blocks: list[np.ndarray], root: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 200.0, steps: int = 12, part: int = 4096):
    """Squared-hinge linear machine by Newton steps; returns weights, the last one the offset.

    Rows are kernel values, and root maps them to Nystroem coordinates; as sums over rows are taken before root
    is applied, the mapped rows are never held."""
    width = root.shape[1] + 1
    starts = np.cumsum([0] + [len(x) for x in blocks])
    parts = [(x[i : i + part], slice(o + i, o + min(i + part, len(x)))) for x, o in zip(blocks, starts, strict=False) for i in range(0, len(x), part)]
    reg, turn = np.eye(width), np.eye(width)
    reg[-1, -1] = 1e-3
    turn[:-1, :-1] = root
    w = np.zeros(width)
    for _ in range(steps):
        gram, side, v = np.zeros((width, width)), np.zeros(width), turn @ w
        for x, at in parts:
            bad = y[at] * (x @ v[:-1] + v[-1]) < 1
            own = np.hstack([x[bad].astype(float), np.ones((int(bad.sum()), 1))])
            a = own * weight[at][bad, None]
            gram += own.T @ a
            side += a.T @ y[at][bad]
        new = np.linalg.solve(reg + c * turn.T @ gram @ turn, c * turn.T @ side)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


class Landmarks:
    """Kernel values of strings with the landmarks, by one row over the landmarks for each subsequence that they hold."""

    def __init__(self, marks: list[str]):
        found = list(subsequences(marks))
        codes = np.unique(np.concatenate([c.ravel() for _, c, _ in found]))
        self.at = np.full(SIGNS**3, len(codes), np.int32)  # subsequences that no landmark holds share a last row of zeros
        self.at[codes] = np.arange(len(codes))
        self.dense = np.zeros((len(codes) + 1, len(marks)), np.float32)
        for rows, c, w in found:
            np.add.at(self.dense, (self.at[c], rows[:, None]), w)

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.dense.shape[1]), np.float32)
        for rows, codes, weights in subsequences(words):
            for i in range(0, len(rows), 64):
                out[rows[i : i + 64]] = np.einsum("f,nfm->nm", weights, self.dense[self.at[codes[i : i + 64]]])
        return out

    def table(self, v: np.ndarray) -> np.ndarray:
        return (self.dense @ v.astype(np.float32))[self.at]


def gapped(w: str) -> list[str]:
    """Forms of an insult with characters put in."""
    return [p for x in (*(w[:i] + ch + w[i:] for i, ch in ((len(w) // 2, "x"), (len(w) // 3 + 1, "1"), (2 * len(w) // 3, "-"))), "-".join(w)) for p in pieces(x)]


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on labelled rows outside the held-out fifth."""
    lab = labels.filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 != 0").select("doc_id", "toxic").distinct()
    one = lambda t, n: lab.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = one(1, MAX_BAGS).unionByName(one(0, 2 * MAX_BAGS))
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text").collect()
    rows = sorted(tuple(r) for r in rows)
    bags = [(toxic, sorted({p for t in tokens(text) for x in forms(t) for p in pieces(x)})) for toxic, text in rows]
    return train([b for toxic, b in bags if toxic == 1], [b for toxic, b in bags if toxic == 0])


def train(toxic: list[list[str]], clean: list[list[str]]) -> Scorer:
    """The machine of toxic and clean bags of strings."""
    t, c = (Counter(w for b in bags for w in b) for bags in (toxic, clean))
    # candidates are strings that are far more frequent in toxic bags; a few mislabelled clean bags do not clear one
    pos = sorted(w for w in t if len(w) > 2 and t[w] * len(clean) > CONTRAST * c[w] * len(toxic))
    mine = set(pos)
    neg = sorted(w for w in c if w not in mine)
    if not pos or not neg:
        return Scorer(np.zeros(SIGNS**3, np.float32), -1.0, 1.0, 30.0)
    rng = np.random.default_rng(7)
    heavy = sorted(pos, key=lambda w: (-t[w], w))[: LANDMARKS // 2]
    marks = heavy + [neg[i] for i in rng.choice(len(neg), min(len(neg), LANDMARKS - len(heavy)), replace=False)]
    marks = [m for m in marks if len(m) > 2]
    land = Landmarks(marks)
    val, vec = np.linalg.eigh(land.kernel(marks).astype(float) + 1e-6 * np.eye(len(marks)))
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-6))) @ vec.T
    index = {w: i for i, w in enumerate(pos)}
    held = [x for x in ([index[w] for w in b if w in index] for b in toxic) if x]
    kp, kn = land.kernel(pos), land.kernel(neg)
    count = np.array([t[w] for w in pos], float)
    chosen, weight = np.arange(len(pos)), count / count.sum() * len(held)
    neg_weight = np.minimum([float(c[w]) for w in neg], 5.0)
    for step in range(ROUNDS):
        extra = [g for i in chosen for g in gapped(pos[i])] if step else []
        y = np.concatenate([np.ones(len(chosen) + len(extra)), -np.ones(len(neg))])
        w = svm([kp[chosen], land.kernel(extra), kn], root, y, np.concatenate([weight, np.full(len(extra), 0.2), neg_weight]))
        v, offset = root @ w[:-1], float(w[-1])
        f = kp @ v + offset
        best = {max(own, key=lambda i: (f[i] + 0.15 * np.log1p(count[i]), -i)) for own in held}
        strong = {i for own in held for i in own if f[i] > 0.5 and count[i] > 1}
        chosen = np.array(sorted(best | strong))
        weight = np.ones(len(chosen))
    scorer = Scorer(land.table(v), offset, 8.0, 0.0)
    tops, calm = (np.array([scorer.words(b).max() if b else -2.0 for b in bags]) for bags in (toxic, clean))
    grid = np.linspace(-1, 1, 81)
    wrong = [(tops < x).mean() + 2 * (calm >= x).mean() for x in grid]
    scorer.shift = float(np.mean(grid[np.isclose(wrong, min(wrong))]))
    return scorer


def score(docs: DataFrame, scorer: Scorer, keep: list[str], name: str = "score") -> DataFrame:
    """The kept columns and the score of each text under a name."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_scored"))
    table, rest = scorer.table, (scorer.offset, scorer.slope, scorer.shift)

    def each(batches):
        own = Scorer(table, *rest)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = pa.array(own.score(part.column(part.num_columns - 1).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*keep, name])

    schema = "".join(f"`{c}` {t}, " for c, t in kept.dtypes[:-1])
    return kept.mapInArrow(each, f"{schema}`{name}` double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    held = F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
