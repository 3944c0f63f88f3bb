"""Order-preserving packing of documents into training sequences of at most 4096 ids.

Documents keep their order within a task; their ids form one stream that is cut into windows. A window of L ids is padded to
the full size, except where L is a power of two. A cut may fall behind a document, behind a sentence (an id whose
piece ends in . ! or ?, or a line's end) or, where a stretch has neither for GRID * 4 ids, at every GRID-th id. The cuts minimise padding
plus OPEN for each sequence and a penalty for each cut (DOC, SENTENCE or INSIDE, all in padded ids), by dynamic programming over the
possible cuts: f(p) = penalty(p) + min f(q) + 4096 - (p - q) over the window of q is read from the front of a monotone queue of
f(q) + q, and the at most 13 q at powers of two before p are looked at one by one.

The stream is worked off in chains of about CHAIN ids, so that a task holds a bounded part of it besides the longest document: cuts up to the
point where the best ways to all open cuts meet are final, the ids after it go on to the next chain (if no
such point exists in a whole chain, the best way is taken). At the end of a task the rest may be cut into powers of two.
Nothing is shuffled: sequence ids number the windows of a task behind the task's own number.

Null and empty texts are documents of one id, the end mark; repeated rows are packed each by itself; rows with a null doc_id keep it;
very long texts run over many sequences; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

SIZE, END, CHAIN, GRID = 4096, 2, 1 << 19, 64
OPEN, DOC, SENTENCE, INSIDE = 16, 1, 8, 64
SLICE_BYTES, TOGETHER, MARK = 16 << 20, 1000, "\x01"
#: Kinds of bytes: signs that never share a token with a letter beside them (' may, and < > | stand in special tokens), and others.
OTHER, LETTER, SIGN = 0, 1, 4
SIGNS = b".,;:!?()[]{}\"-/*+=_%&#@$"
KIND = np.full(256, OTHER, "uint8")
KIND[65:91] = KIND[97:123] = LETTER
KIND[list(SIGNS)] = SIGN
LOWER = np.arange(256, dtype="uint8")
LOWER[65:91] += 32


class Words:
    """Ids of texts, by their distinct words.

    No token reaches over a space or a line's end, nor from a letter to one of SIGNS or back, so that a text's ids are those of the
    stretches between such places one after another. Stretches of Latin-1 letters are put in lower case and are one word each to the
    tokenizer, whose last id, and no other, ends a word; the others are encoded with a mark between them, and one by one where one holds the mark."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.letters = Tokenizer.from_file(model), Tokenizer.from_file(model)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.stops, self.last = np.zeros(max(vocab.values()) + 1, bool), np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.stops[i], self.last[i] = piece.removesuffix("</w>").endswith((".", "!", "?")), piece.endswith("</w>")
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def learn(self, words: pa.Array, letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        tokenizer = self.letters if letters else self.tokenizer
        bounds = np.append(np.arange(0, len(words), TOGETHER), len(words)).astype("int32")
        joined = pc.binary_join(pa.ListArray.from_arrays(bounds, words.cast(pa.string())), " " if letters else f" {MARK} ").to_pylist()
        ids, sizes = [np.zeros(0, "uint32")], [np.zeros(0, "int64")]
        for found, a, b in zip(tokenizer.encode_batch_fast(joined, add_special_tokens=False), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.array(found.ids, "uint32")
            if letters:
                ids.append(own)
                sizes.append(np.diff(np.nonzero(self.last[own])[0], prepend=-1))
                continue
            marks = np.nonzero(own == self.mark)[0]
            if len(marks) == b - a - 1:
                ids.append(np.delete(own, marks))
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(own)]])) - 1)
            else:
                single = [e.ids for e in tokenizer.encode_batch_fast(words[a:b].to_pylist(), add_special_tokens=False)]
                ids.append(np.array([i for w in single for i in w], "uint32"))
                sizes.append(np.fromiter(map(len, single), "int64", b - a))
        return np.concatenate(ids), np.concatenate(sizes)

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each, by the words' distinct stretches."""
        words = words.cast(pa.large_string())
        till = np.cumsum(pc.binary_length(words).to_numpy())
        total, at = int(till[-1]) if len(till) else 0, int(np.frombuffer(words.buffers()[1], "int64", count=words.offset + 1)[-1])
        data = np.frombuffer(words.buffers()[2] or b"", "uint8", count=total, offset=at)
        kind, low = KIND[data], LOWER[data]
        two = np.nonzero(data[:-1] == 0xC3)[0]  # lead byte of the upper half of Latin-1, letters but for two signs
        two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
        kind[two] = kind[two + 1] = LETTER
        upper = two[data[two + 1] <= 0x9E] + 1
        low[upper] = data[upper] + 0x20
        begin = np.append(True, kind[1:] + kind[:-1] == LETTER + SIGN)[:total]
        begin[till[till < total]] = True
        first = np.nonzero(begin)[0]
        pure = np.add.reduceat(kind != LETTER, first, dtype="int64") == 0 if total else np.zeros(0, bool)
        held = np.where(np.repeat(pure, np.diff(first, append=total)), low, data)
        coded = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.append(first, total)), pa.py_buffer(held)]).dictionary_encode()
        code = coded.indices.to_numpy()
        letters = np.zeros(len(coded.dictionary), bool)
        letters[code] = pure
        pool, start, size = [np.zeros(0, "uint32")], np.zeros(len(letters), "int64"), np.zeros(len(letters), "int64")
        for which in (True, False):
            own = np.nonzero(letters == which)[0]
            if len(own):
                ids, n = self.learn(coded.dictionary.take(pa.array(own)), which)
                start[own], size[own] = sum(map(len, pool)) + np.cumsum(n) - n, n
                pool.append(ids)
        flat, ends = gathered(np.concatenate(pool), start[code], size[code])
        return flat, np.diff(ends[np.searchsorted(first, till)], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts with an end mark behind each, the number of ids of each, and whether a sentence ends behind an id."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n "), " ")
        coded = parts.flatten().dictionary_encode()
        ids, size = self.spell(coded.dictionary)
        rows = np.cumsum(pc.list_value_length(parts).to_numpy())
        end = len(coded.dictionary)  # one more word, the end mark
        code = np.insert(coded.indices.to_numpy(), rows, end)
        ids, size = np.append(ids, np.uint32(END)), np.append(size, 1)
        flat, ends = gathered(ids, (np.cumsum(size) - size)[code], size[code])
        counts = np.diff(ends[rows + np.arange(1, len(rows) + 1)], prepend=0)
        stop = self.stops[flat]
        line = pc.index(coded.dictionary, "\n").as_py()
        if line >= 0:
            before = ends[np.nonzero(code == line)[0]]
            stop[before[before > 0] - 1] = True
        return flat, counts, stop


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of a pool one after another, and where each begins and the last one ends."""
    ends = np.concatenate([[0], np.cumsum(size)])
    kind = "int32" if max(len(pool), ends[-1]) < 2**31 else "int64"
    return pool[np.repeat((start - ends[:-1]).astype(kind), size) + np.arange(ends[-1], dtype=kind)], ends


@cache
def words_of(model: str) -> Words:
    return Words(model)


def places(docs: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may fall, counted in ids before them, and the penalty of each; docs: ends of documents."""
    mark = np.zeros(len(stop) + 1, "uint8")
    mark[1:][stop] = SENTENCE
    mark[docs - 1] = 0  # not between a document's last id and its end mark
    mark[docs] = DOC
    ends = np.nonzero(mark)[0]
    gaps = np.diff(ends, prepend=0)
    for i in np.nonzero(gaps > 4 * GRID)[0].tolist():
        mark[ends[i] - gaps[i] + GRID : ends[i] : GRID] = INSIDE
    at = np.nonzero(mark)[0]
    return at, mark[at].astype("int64")


def ways(at: np.ndarray, cost: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Positions from 0 on, the least cost of each as a cut, and the cut before it; no two positions are more than SIZE apart."""
    at = np.concatenate([[0], at])
    hits: dict[int, list[int]] = {}
    for k in range(SIZE.bit_length()):
        j = np.searchsorted(at, at - (1 << k))
        own = np.nonzero(at[j] == at - (1 << k))[0]
        for i, h in zip(own.tolist(), j[own].tolist(), strict=True):
            hits.setdefault(i, []).append(h)
    pos, price = at.tolist(), [0, *(cost + OPEN).tolist()]
    best, back = [0] * len(pos), [0] * len(pos)
    keys, numbers, head = [0], [0], 0  # the queue from head on: rising f(q) + q, and the number of q
    for i, p in enumerate(pos):
        if not i:
            continue
        while pos[numbers[head]] < p - SIZE:
            head += 1
        least, j = keys[head] + SIZE - p, numbers[head]
        if i in hits:
            for h in hits[i]:
                if best[h] <= least:
                    least, j = best[h], h
        best[i], back[i] = least + price[i], j
        key = least + price[i] + p
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            numbers.pop()
        keys.append(key)
        numbers.append(i)
    return pos, best, back


def trail(pos: list[int], back: list[int], i: int) -> list[int]:
    """The cuts from 0 to the i-th position."""
    out = [pos[i]]
    while i:
        i = back[i]
        out.append(pos[i])
    return out[::-1]


def cuts(docs: np.ndarray, stop: np.ndarray, last: bool) -> list[int]:
    """Cuts of a chain from 0 on; the ids after the last cut are left to the next chain, if this is not the last one."""
    pos, best, back = ways(*places(docs, stop))
    end = pos[-1]
    near = range(np.searchsorted(pos, end - SIZE + 1), len(pos))
    if not last:
        meet = set(near)
        while len(meet) > 1:
            i = max(meet)
            meet.remove(i)
            meet.add(back[i])
        return trail(pos, back, meet.pop() or min(near, key=lambda i: (best[i], -i)))
    i = min(near, key=lambda i: best[i] + (end - pos[i]).bit_count() * (OPEN + INSIDE))
    if best[i] + (end - pos[i]).bit_count() * (OPEN + INSIDE) >= best[-1]:
        return trail(pos, back, len(pos) - 1)
    out = trail(pos, back, i)
    for k in range(SIZE.bit_length(), -1, -1):
        if (end - pos[i]) >> k & 1:
            out.append(out[-1] + (1 << k))
    return out


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OUT = pa.schema([(f.split()[0], pa.int64()) for f in FIELDS.split(", ")])


class Stream:
    """The documents of a task that are not packed yet."""

    def __init__(self, task: int, chain: int = CHAIN):
        self.next, self.chain, self.ids, self.stop = task << 40, chain, [], []
        self.rows: list[np.ndarray] = []  # doc_id, known, ids of the document before, ids here, ids of the document
        self.held = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = pc.is_valid(doc_ids).to_numpy(zero_copy_only=False)
        self.ids.append(ids)
        self.stop.append(stop)
        self.rows.append(np.stack([pc.fill_null(doc_ids, 0).to_numpy(), known, np.zeros_like(sizes), sizes, sizes], 1).astype("int64"))
        self.held += len(ids)
        if self.held >= self.chain:
            yield from self.pack(False)

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        ids, stop, rows = np.concatenate(self.ids), np.concatenate(self.stop), np.concatenate(self.rows)
        ends = np.cumsum(rows[:, 3])
        at = np.array(cuts(ends, stop, last))
        done = at[-1]
        edges = np.union1d(at, ends[ends < done])
        first, after = edges[:-1], edges[1:]
        row, seq = np.searchsorted(ends, first, "right"), np.searchsorted(at, first, "right") - 1
        data = ids.astype("<u4", copy=False)
        crc = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), after.tolist(), strict=True)]
        begun = ends - rows[:, 3]
        columns = [pa.array(rows[row, 0], mask=rows[row, 1] == 0), rows[row, 2] + first - begun[row], after - first, np.array(crc, "int64"), rows[row, 4], self.next + seq, first - at[seq]]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=OUT)
        self.next += len(at) - 1
        left = rows[np.searchsorted(ends, done, "right") :].copy()
        if len(left):
            gone = left[0, 3] - (ends[len(rows) - len(left)] - done)
            left[0, 2] += gone
            left[0, 3] -= gone
        self.ids, self.stop, self.rows, self.held = [ids[done:].copy()], [stop[done:].copy()], [left], len(ids) - int(done)


def pack(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("word_bpe_49k.json")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stream = words_of(model), Stream(TaskContext.get().partitionId(), chain)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            share = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype("int64")) // SLICE_BYTES
            bounds = [0, *(np.nonzero(np.diff(share))[0] + 1).tolist(), len(share)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b > a:
                    yield from stream.add(doc_ids[a:b], *words.encode(texts[a:b]))
        yield from stream.pack(True)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(each, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
