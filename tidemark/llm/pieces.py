"""SentencePiece encoding and decoding by streaming Viterbi.

Scores are those of the model file. The search runs over a text once. Only as many boundaries as the longest piece has
characters are open at a time; the backpointer paths of these survivors are followed back, and when all converge on one
boundary, the ids up to it are committed and everything before it is dropped. Paths that have not met are looked at again
after twice the way, so a text costs time in proportion to its length, unbroken or not. (Backpointers that have not met
must be kept: in a text of one letter the paths meet at its end only.)

A piece holds the word mark only at its start and never a line feed, so all paths meet before a mark and around a
line feed. The ids of the stretches between them are kept in a table of at most REMEMBER short stretches, which stands
in front of the same search.

Texts are encoded as they are (no normalisation), each space as the mark; characters without a piece, and the mark
itself where a text holds it, become byte pieces, so decoding gives every text back exactly. Null and empty texts give no
ids. Every row gives one row, repeated rows too; an empty table gives none; columns to keep whose names are those of
results are left out.
"""

from __future__ import annotations

from array import array
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MARK, REMEMBER, SHORT, PENDING, BYTE_PENALTY = "▁", 300_000, 64, 64, 1e6
#: Stands for the mark in a text while it is encoded; no text that Spark reads can hold it.
LITERAL = "\udfff"
RESULTS = ("ids", "n_ids", "round_trip")


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        self.shown: list[str] = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            self.shown.append(p.replace(MARK, " "))
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[p] = (i, sp.get_score(i))
        self.unbyte = {i: b for b, i in self.byte.items()}
        for i, b in self.unbyte.items():
            self.shown[i] = chr(b) if b < 128 else ""
        self.high = np.array(sorted(i for i, b in self.unbyte.items() if b >= 128), np.int32)
        self.longest = max(map(len, self.ids))
        self.found = ahocorasick.Automaton()  # gives the pieces that end at each place of a text, the longest first
        for p, (i, gain) in self.ids.items():
            self.found.add_word(p, (len(p), gain, i))
        self.found.make_automaton()
        self.parted = all(MARK not in p.lstrip(MARK) and "\n" not in p for p in self.ids)
        self.marked: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.widest = 0

    def raw(self, c: str) -> list[int]:
        return [self.byte[b] for b in (MARK if c == LITERAL else c).encode("utf-8", "surrogatepass")]

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; of paths of equal score the one with the longest last piece."""
        out: list[int] = []
        best, back = [0.0], [None]  # score, and (predecessor, piece), of each pending boundary from base on
        base, at, look = 0, 0, PENDING
        top, way = None, None  # the best path that ends at boundary at + 1
        for last, (length, gain, piece) in self.found.iter(text):
            while at < last:  # boundary at + 1 has had all its pieces
                at += 1
                if way is None:
                    top, way = best[-1] - BYTE_PENALTY, (at - 1, -1)
                best.append(top)
                back.append(way)
                top = way = None
                if at - base >= look:
                    meet = self.meeting(back, base, at, self.longest)
                    if meet > base:
                        out.extend(self.path(text, back, base, meet))
                        best, back, base, look = best[meet - base :], back[meet - base :], meet, PENDING
                    else:  # as nothing has met, look again after twice the way, which keeps the work in proportion
                        look *= 2
            score = best[-length] + gain
            if way is None or score > top:
                top, way = score, (last + 1 - length, piece)
        while at < len(text):
            at += 1
            back.append(way or (at - 1, -1))
            best.append(top if way else best[-1] - BYTE_PENALTY)
            top = way = None
        self.widest = max(self.widest, at - base)
        out.extend(self.path(text, back, base, at))
        return out

    @staticmethod
    def meeting(back, base: int, at: int, longest: int) -> int:
        """The last boundary that all paths run through which can still grow, those to the last boundaries up to at."""
        live = set(range(max(base, at - longest + 1), at + 1))
        order = [-e for e in live]
        heapify(order)
        while len(live) > 1:
            last = -heappop(order)
            live.discard(last)
            if last <= base:
                return base
            before = back[last - base][0]
            if before not in live:
                live.add(before)
                heappush(order, -before)
        return live.pop()

    def path(self, text: str, back, base: int, end: int) -> list[int]:
        """Ids from base to a boundary."""
        ids: list[int] = []
        while end > base:
            end, piece = back[end - base]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(reversed(self.raw(text[end])))
        ids.reverse()
        return ids

    def packed(self, text: str, table: dict[str, bytes], lead: str) -> bytes:
        """Ids of a stretch as 32-bit integers, from the table or by search."""
        got = table.get(text)
        if got is None:
            got = array("i", self.viterbi(lead + text)).tobytes()
            if len(text) <= SHORT:
                if len(table) >= REMEMBER:
                    table.clear()
                table[text] = got
        return got

    def word(self, w: str) -> bytes:
        """Ids of a space and the word after it, line feeds included."""
        if "\n" not in w:
            return self.packed(w, self.marked, MARK)
        first, *lines = w.split("\n")
        feed = array("i", self.raw("\n")).tobytes()
        return self.packed(first, self.marked, MARK) + b"".join(feed + (self.packed(x, self.plain, "") if x else b"") for x in lines)

    def encode_packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        text = text.replace(MARK, LITERAL) if MARK in text else text
        if not self.parted:
            return array("i", self.viterbi(MARK + text.replace(" ", MARK))).tobytes()
        words, table, out = text.split(" "), self.marked, []
        get, spaces = table.get, 0
        for w in words:
            if not w:
                spaces += 1
                continue
            if spaces:  # a run of spaces belongs to the word after it
                head, *tail = w.split("\n", 1)
                out.append(self.packed(MARK * (spaces + 1) + head, self.plain, ""))
                if tail:
                    out.append(self.word("\n" + tail[0])[len(self.packed("", table, MARK)) :])
                spaces = 0
                continue
            out.append(get(w) or self.word(w))
        if spaces:
            out.append(array("i", self.viterbi(MARK * spaces)).tobytes())
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int32)
        if not np.isin(ids, self.high).any():
            return "".join(map(self.shown.__getitem__, ids.tolist()))[1:]
        parts, raw = [], bytearray()
        for i in ids.tolist():
            if i in self.unbyte:
                raw.append(self.unbyte[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "surrogatepass"))
                raw = bytearray()
            parts.append(self.shown[i])
        parts.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(parts)[1:]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with ids and n_ids of each text, and whether decoding the ids gives the text back."""
    path = path or model_path()
    keep = [c for c in keep or [id_col] if c.lower() not in RESULTS]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_encoded"))

    def each(batches):
        codec = Codec(path)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            packed = [codec.encode_packed(t) for t in texts]
            ends = np.cumsum([0] + [len(p) // 4 for p in packed])
            ids = np.frombuffer(b"".join(packed), np.int32)
            sound = [codec.decode(ids[a:z]) == (t or "") for t, a, z in zip(texts, ends[:-1], ends[1:], strict=True)]
            new = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(np.diff(ends), pa.int64()), pa.array(sound, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*keep, *RESULTS])

    schema = "".join(f"`{c}` {t}, " for c, t in kept.dtypes[:-1])
    return kept.mapInArrow(each, f"{schema}ids array<int>, n_ids long, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
