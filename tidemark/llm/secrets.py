"""Secret scan with corpus-wide ownership counts.

Candidates are found by three base patterns and by provider key patterns, in one pass over the texts whose result is
kept in the shared folder. Their hashes are counted over distinct repositories (source, lang) and owners (source): a value
that many owners hold is a copied example, one that fewer hold looks live.

Spans are code points, end exclusive. Null texts count as empty; repeated rows each give a row with the counts of that
row, also where ids are null; an empty table gives none; other columns are not read, whatever their names. All work
is Spark SQL; hot values are counted by partial aggregation, first by owner and repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.storage import saved

ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group that holds the value, least characters of it; base kinds first, in order.
BASE = [("assign", ASSIGN, 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
EXTRA = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
]
#: A value that at least so many owners hold is a copied example.
EXAMPLE_OWNERS = 3


def _found(text: str, kind: str, order: int, rx: str, group: int, least: int):
    """Array of (s, o, e, kind, value): positions follow from the lengths of the pieces between matches."""
    pick = "{0,}" if least <= 1 else "{%d,}" % least
    # hex runs are maximal, so asking for the least length in the pattern finds the same runs
    rx = r"(?<![0-9a-f])[0-9a-f]" + pick if kind == "hex" else rx
    t = F.col(text)
    whole = F.regexp_extract_all(t, F.lit(rx), F.lit(0))
    values = F.regexp_extract_all(t, F.lit(rx), F.lit(group))
    gaps = F.split(t, rx, -1)
    rows = F.reduce(
        F.sequence(F.lit(0), F.size(whole) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,o:int,e:int,kind:string,value:string>>").alias("out")),
        lambda a, i: F.struct(
            (a["at"] + F.length(F.get(gaps, i)) + F.length(F.get(whole, i))).alias("at"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (a["at"] + F.length(F.get(gaps, i))).alias("s"), F.lit(order).alias("o"), (a["at"] + F.length(F.get(gaps, i)) + F.length(F.get(whole, i))).alias("e"), F.lit(kind).alias("kind"), F.get(values, i).alias("value"),
                    )
                ),
            ).alias("out"),
        ),
        lambda a: F.filter(a["out"], lambda r: F.length(r["value"]) >= least),
    )
    return F.when(F.size(whole) > 0, rows).otherwise(F.array().cast("array<struct<s:int,o:int,e:int,kind:string,value:string>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document with its candidates: array found of (s, o, e, kind, value), by start."""
    kinds = BASE + EXTRA
    d = docs.select(id_col, *carry, F.coalesce(text_col, F.lit("")).alias("_t"))
    for n, (kind, rx, group, least) in enumerate(kinds):
        d = d.withColumn(f"_f{n}", _found("_t", kind, n, rx, group, least))
    return d.select(id_col, *carry, F.array_sort(F.concat(*[f"_f{n}" for n in range(len(kinds))])).alias("found"))


def hashes(found: DataFrame, *carry) -> DataFrame:
    """One row for each document and distinct candidate: the carried columns and the candidate's hash."""
    own = F.array_distinct(F.transform("found", lambda r: F.sha2(r["value"], 256)))
    return found.filter(F.size("found") > 0).select(*carry, F.explode(own).alias("hash"))


def ownership(one: DataFrame, owner: str, repository: str) -> DataFrame:
    """Per candidate hash of hashes(): distinct repositories and owners, and whether it looks live."""
    one = one.select("hash", F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"))
    each = one.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    per_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    counts = per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n_docs"))
    return counts.withColumn("verdict", F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").otherwise("live"))


def spans(found, only=None):
    kept = F.filter(found, only) if only else found
    return F.array_join(F.transform(kept, lambda r: F.concat_ws(":", r["kind"], r["s"].cast("string"), r["e"].cast("string"))), ",")


def report(docs: DataFrame, owner: str = "source", repository: str = "_repository") -> DataFrame:
    """Digest columns of the scan, with the number of live-looking values of each document."""
    d = docs.withColumn("_repository", F.concat_ws("/", "source", "lang")) if repository == "_repository" else docs
    # rows are numbered as they are stored, as ids may repeat
    found = saved(scan(d, carry=(owner, repository))).withColumn("_n", F.monotonically_increasing_id())
    used = hashes(found, "_n", owner, repository)
    owned = ownership(used, owner, repository).filter("verdict = 'live'").select("hash")
    live = used.join(owned, "hash").groupBy("_n").agg(F.count("*").alias("n_live"))
    n = lambda kind: F.size(F.filter("found", lambda r: r["kind"] == kind)).cast("long")
    return found.join(live, "_n", "left").select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(spans(F.col("found"), lambda r: r["o"] < len(BASE)), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "_repository") -> DataFrame:
    """Documents with each value that looks live replaced by a mark, all rows and columns kept.

    Ownership is counted over all of docs; copied examples stay as they are, overlapping live values give one mark."""
    d = docs.withColumn("_repository", F.concat_ws("/", "source", "lang")) if repository == "_repository" else docs
    used = saved(hashes(scan(d, carry=(owner, repository)), F.col("doc_id").alias("_id"), owner, repository))
    owned = ownership(used, owner, repository).filter("verdict = 'live'").select("hash")
    live = used.join(owned, "hash").groupBy("_id").agg(F.collect_set("hash").alias("_live"))
    rows = scan(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), carry=("_row",)).join(live, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    marked = F.filter("found", lambda r: F.array_contains("_live", F.sha2(r["value"], 256)))
    # a value ends where its match ends
    values = F.array_sort(F.transform(marked, lambda r: F.struct((r["e"] - F.length(r["value"])).alias("s"), r["e"].alias("e"))))
    t = F.col("_row.text")
    kept = F.reduce(
        values,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, r: F.struct(
            F.greatest(a["at"], r["e"]).alias("at"),
            F.when((r["s"] >= a["at"]), F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, r["s"] - a["at"]), F.lit("[SECRET]")))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, F.length(t)))), ""),
    )
    text = F.when(F.col("_live").isNull(), t).otherwise(kept)
    return rows.select(*[(text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c)) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
