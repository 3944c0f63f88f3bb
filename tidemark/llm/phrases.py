"""Phrases of 2 to 5 words that stand together more often than their parts let expect, for each language.

Words are counted first, exactly and in all; no word below the least count can stand in a phrase that reaches it. Then SON partitioning in
two passes over the texts. First every shard (a task's texts, up to SHARD_WORDS words) is mined completely: with m of a
language's n words in it, the shard's support is ceil(least * m / n), and a phrase that reaches least occurrences in all
reaches that in one shard at least. Within a shard phrases grow word by word: one of k words is counted where both its parts
of k - 1 words are frequent, the words in all and longer parts in the shard. Shards hand over their frequent phrases with their counts; the
union keeps those that could still reach the least count, if every other shard held one occurrence less than its
support. Second, all shards count the phrases of the union, and the counts are summed and tested exactly.

A shard learns the frequent words and the union from Bloom filters of BLOOM_BITS bits each, whatever the number of phrases: one that a filter
lets through by mistake is counted like the others and tested by its exact count, so that a full filter costs time only.
A shard's arrays are bounded by SHARD_WORDS and its longest text. Tasks are merged until they fill shards or are as few as the cores. Shards grow in
number with the corpus and their support falls, down to one, where each hands over all its phrases of frequent words.

Null texts are empty; null languages are `und`; repeated rows count each by itself; ties go by count and then by the phrase's bytes; an empty
table gives no rows; other columns are not read. Scores are floors of exact quotients in decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.storage import saved

LONGEST, LEAST, TOP, FEW_LANGUAGES = 5, 100, 2000, 10_000
SHARD_WORDS, BLOOM_BITS, PROBES, SPELLED = 14_000_000, 1 << 25, 3, 100_000
SLICE_BYTES, BLOCK, DEALS = 4 << 20, 1 << 20, 16
LOWER = np.arange(256, dtype="uint8")
LOWER[65:91] += 32
BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANK[list(b" \t")] = True


def parsed(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, the number of each occurrence's word, and the occurrences that begin a piece."""
    texts = texts.cast(pa.large_binary())
    size = pc.binary_length(texts).to_numpy()
    buffers = texts.buffers()
    at = int(np.frombuffer(buffers[1], "int64", count=texts.offset + 1)[-1])
    data = LOWER[np.frombuffer(buffers[2] or b"", "uint8", count=int(size.sum()), offset=at)]
    letter = ~(BREAK[data] | BLANK[data])
    ends = np.cumsum(size)
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    fresh = ends[:-1][ends[:-1] < len(data)]
    begin[fresh] = letter[fresh]  # a text's first word does not go on from the text before
    first = np.nonzero(begin)[0]
    stop = letter.copy()
    stop[:-1] &= ~letter[1:] | begin[1:]
    offsets = np.concatenate([[0], np.cumsum(np.nonzero(stop)[0] - first + 1)]).astype("int64")
    # pieces are told apart by the breaks and texts before them
    piece = np.searchsorted(np.nonzero(BREAK[data])[0], first) + np.searchsorted(ends, first, "right")
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), np.nonzero(np.diff(piece, prepend=-1))[0]


class Shard:
    """Words of some texts by their numbers, -1 between pieces, and the distinct words."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, texts: pa.Array) -> None:
        words, ids, begins = parsed(texts)
        own = np.fromiter((self.number.setdefault(w, len(self.number)) for w in words.to_pylist()), "int32", len(words))
        self.parts.append(np.insert(own[ids], begins, -1))
        self.held += len(ids)

    def closed(self) -> Shard:
        self.ids = np.concatenate([*self.parts, np.full(LONGEST, -1, "int32")])
        self.parts = []
        self.words = pa.array(list(self.number), pa.large_binary()).cast(pa.large_string())
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.number), "uint64", len(self.number))
        self.number = {}
        pa.default_memory_pool().release_unused()
        return self

    def hashes(self, k: int, starts: np.ndarray) -> np.ndarray:
        """Hashes of stretches of k words; of one word, its own."""
        out = self.hash[self.ids[starts]]
        for j in range(1, k):
            out = mixed(out + self.hash[self.ids[starts + j]])
        return out

    def pairs(self, good: np.ndarray) -> np.ndarray:
        """Places that are good and followed by a good one."""
        out = [np.zeros(0, "int32")]
        for a in range(0, len(good) - 1, BLOCK):
            out.append((np.nonzero(good[a : a + BLOCK][: len(good) - 1 - a] & good[a + 1 : a + BLOCK + 1])[0] + a).astype("int32"))
        return np.concatenate(out)

    def asked(self, k: int, good: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Good starts of stretches of k words that a filter lets through, and a group of each, equal stretches in one."""
        out, group = [np.zeros(0, "int32")], [np.zeros(0, "uint8")]
        for a in range(0, len(good), BLOCK):
            starts = (np.nonzero(good[a : a + BLOCK])[0] + a).astype("int32")
            h = self.hashes(k, starts)
            ok = passes(h, table, bits)
            out.append(starts[ok])
            group.append((h[ok] % np.uint64(DEALS)).astype("uint8"))
        return np.concatenate(out), np.concatenate(group)

    def names(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Whole numbers, equal for equal stretches of k words and for no others."""
        names = self.ids[starts].astype("int64")
        for j in range(1, k):
            names = names * max(1, len(self.words)) + self.ids[starts + j]
            if j + 1 < k:
                names = np.unique(names, return_inverse=True)[1]
        return names

    def spelled(self, starts: np.ndarray, k: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.ids[starts + j])) for j in range(k)]
        return (parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))).cast(pa.string())

    def rows(self, lang: str, starts: np.ndarray, k: int, columns: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """lang, phrase, words and further columns of stretches of k words, spelled a part at a time."""
        for a in range(0, len(starts), SPELLED):
            own = starts[a : a + SPELLED]
            head = [pa.array(np.full(len(own), lang, object), pa.string()), self.spelled(own, k), pa.array(np.full(len(own), k, "int32"))]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(c[a : a + SPELLED]) for c in columns)], schema=schema)

    def frequent(self, support: int, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """k, starts and counts of all phrases of two and more known words with at least the support."""
        number, size = np.append(np.where(known, np.arange(len(known)), -1), -1).astype("int32")[self.ids], max(1, len(self.words))
        for k in range(2, LONGEST + 1):
            # a phrase starts where one frequent part starts and the next one a word later
            left = self.pairs(number >= 0)
            name = np.zeros(len(left), "int64")
            for a in range(0, len(left), BLOCK):
                at = left[a : a + BLOCK]
                name[a : a + BLOCK] = number[at].astype("int64") * size + number[at + 1]
            number[:], size, kept = -1, 0, []
            for own in dealt(name):
                _, one, place, count = np.unique(name[own], return_index=True, return_inverse=True, return_counts=True)
                much = count >= support
                among = much[place]
                number[left[own[among]]] = (np.cumsum(much) - 1)[place[among]] + size
                size += int(much.sum())
                kept.append((left[own[one[much]]], count[much]))
            yield k, *(np.concatenate(x) for x in zip(*kept, strict=True))
            size = max(1, size)


def dealt(name: np.ndarray) -> Iterator[np.ndarray]:
    """Places of names in DEALS groups, equal ones together, so that each group is sorted by itself."""
    group = np.zeros(len(name), "uint8")
    for a in range(0, len(name), BLOCK):
        group[a : a + BLOCK] = (name[a : a + BLOCK].astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(DEALS)
    for g in range(DEALS):
        yield np.nonzero(group == g)[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of hashes; parts of it are put together by Spark, and at most bits / 64 rows reach the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view("uint64")
            at = np.unique(np.concatenate([bit(h, j, bits) for j in range(PROBES)]))
            word, first = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype("uint64"), first) if len(at) else np.zeros(0, "uint64")
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view("int64"))], names=["word", "mask"])

    table = np.zeros(-(-bits // 64), "uint64")
    for part in hashes.mapInArrow(each, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        table[part.column(0).to_numpy()] = part.column(1).to_numpy().view("uint64")
    return table


def passes(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(h), bool)
    for j in range(PROBES):
        at = bit(h, j, bits)
        out &= table[at >> 6] >> (at & 63).astype("uint64") & np.uint64(1) == 1
    return out


def bit(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (mixed(h + np.uint64(probe)) % np.uint64(bits)).astype("int64")


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, int, Shard]]:
    """Languages, their words in all and shards of a task's rows (lang, text, n); the largest goes when `most` words are held."""
    held: dict[tuple[str, int], Shard] = {}
    for b in batches:
        share = np.cumsum(pc.binary_length(b.column(1)).to_numpy().astype("int64")) // SLICE_BYTES
        bounds = [0, *(np.nonzero(np.diff(share))[0] + 1).tolist(), len(share)]
        for part in (b.slice(a, z - a) for a, z in zip(bounds, bounds[1:], strict=False) if z > a):
            for lang in part.column(0).unique().to_pylist():
                own = part.filter(pc.equal(part.column(0), lang))
                held.setdefault((lang, own.column(2)[0].as_py()), Shard()).add(own.column(1))
        while sum(s.held for s in held.values()) >= most:
            key = max(held, key=lambda k: held[k].held)
            yield *key, held.pop(key).closed()
    while held:
        key, own = held.popitem()
        yield *key, own.closed()


def counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS, bits: int = BLOOM_BITS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words and a of all phrases of up to LONGEST words with at least `least` occurrences; lang and n."""
    spark = docs.sparkSession
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(lang, F.regexp_count(text, F.lit(r"[^ \t.,;:!?\n\x0B\f\r]+")).alias("n"))
    totals = saved(words.groupBy("lang").agg(F.sum("n").cast("long").alias("n")).filter(F.col("n") > 0))
    small = totals.count() <= FEW_LANGUAGES
    rows = docs.select(lang, text.cast("binary").alias("text")).join(F.broadcast(totals) if small else totals, "lang").select("lang", "text", "n")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, shard in shards(batches, shard_words):
            at = np.nonzero(shard.ids >= 0)[0]
            one, n = np.zeros(len(shard.words), "int32"), np.bincount(shard.ids[at], minlength=len(shard.words))
            one[shard.ids[at]] = at
            yield from shard.rows(lang, one, 1, [shard.hash.view("int64"), n], worded)

    single = rows.mapInArrow(count_words, "lang string, phrase string, words int, hash long, a long")
    single = saved(single.groupBy("lang", "phrase", "words", "hash").agg(F.sum("a").alias("a")).filter(F.col("a") >= least))
    known = spark.sparkContext.broadcast(bloom(single.select("hash"), bits))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, n, shard in shards(batches, shard_words):
            support = max(1, -(-least * shard.held // n))
            head = [pa.array([lang]), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([0]), pa.array([0]), pa.array([support - 1])]
            yield pa.RecordBatch.from_arrays(head, schema=mined)
            for k, starts, count in shard.frequent(support, passes(shard.hash, known.value, bits)):
                yield from shard.rows(lang, starts, k, [shard.hashes(k, starts).view("int64"), count, np.full(len(starts), support - 1)], mined)
            del shard  # before the next one is put together

    # fewer, larger shards have a higher support and hand over less; merging tasks moves nothing
    tasks = max(spark.sparkContext.defaultParallelism, -(-(totals.agg(F.sum("n")).head()[0] or 0) // shard_words))
    rows = rows.coalesce(tasks)
    found = saved(rows.mapInArrow(mine, "lang string, phrase string, words int, hash long, a long, missed long"))
    slack = found.filter(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("missed").alias("slack"))
    union = found.filter(F.col("phrase").isNotNull()).groupBy("lang", "phrase", "words", "hash").agg(F.sum("a").alias("a"), F.sum("missed").alias("missed"))
    union = union.join(slack, "lang").filter(F.col("a") + F.col("slack") - F.col("missed") >= least)
    asked = spark.sparkContext.broadcast(bloom(union.select("hash"), bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, shard in shards(batches, shard_words):
            good = np.append(passes(shard.hash, known.value, bits), False)[shard.ids]
            all_good = good
            for k in range(2, LONGEST + 1):
                all_good = all_good[:-1] & good[k - 1 :]
                starts, group = shard.asked(k, all_good, asked.value, bits)
                for g in range(DEALS):
                    own = starts[group == g]
                    _, one, n = np.unique(shard.names(own, k), return_index=True, return_counts=True)
                    yield from shard.rows(lang, own[one], k, [n], summed)
            del shard, good, all_good

    each = rows.mapInArrow(count, "lang string, phrase string, words int, a long")
    longer = each.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return single.drop("hash").unionByName(longer), totals


worded = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("hash", pa.int64()), ("a", pa.int64())])
mined = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("hash", pa.int64()), ("a", pa.int64()), ("missed", pa.int64())])
summed = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score."""
    found, totals = counts(docs, least, **options)
    found = saved(found)
    phrases = found.filter("words > 1")
    words = F.split("phrase", " ")
    # a phrase inside a longer one of the same count lies in one that is a word longer and has that count too
    shorter = F.array(*[F.array_join(F.slice(words, F.lit(i), F.size(words) - 1), " ") for i in (1, 2)])
    inside = phrases.filter("words > 2").select("lang", F.explode(shorter).alias("phrase"), "a").distinct()
    kept = phrases.join(inside, ["lang", "phrase", "a"], "left_anti")
    cut = lambda first, size: F.array_join(F.slice(words, first, size), " ")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({"first": cut(F.lit(1), F.col("k")), "rest": cut(F.col("k") + 1, F.col("words") - F.col("k"))})
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    cuts = cuts.withColumn("score", F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """with d as (select coalesce(lang, 'und') as lang, row_number() over () as i, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
 p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as t from d),
 w as materialized (select lang, list_filter(regexp_split_to_array(t, '[ \\t]+'), lambda x: x <> '') as w from p),
 n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
 g as (select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase from w cross join range(1, 6) s(m) where len(w) >= m),
 f as materialized (select lang, phrase, m, count(*) as a from g group by all having count(*) >= 100),
 inside as (select lang, unnest([array_to_string(string_split(phrase, ' ')[1:m - 1], ' '), array_to_string(string_split(phrase, ' ')[2:m], ' ')]) as phrase, a from f where m > 2),
 kept as (select * from f where m > 1 and not exists (select 1 from inside where inside.lang = f.lang and inside.phrase = f.phrase and inside.a = f.a)),
 cut as (select lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as x, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') as y from kept cross join range(1, 5) s(k) where k < m),
 scored as (select cut.*, l.a as l, r.a as r, n.n, cast((1000::hugeint * cut.a * n.n) // (l.a::hugeint * r.a) as bigint) as score
  from cut join f l on l.lang = cut.lang and l.phrase = x join f r on r.lang = cut.lang and r.phrase = y join n on n.lang = cut.lang),
 best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
 select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best qualify rank <= 2000"""
