"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `window` consecutive words (a shorter item is one window). A window is a set of
word shingles, and a document contains it only if it contains every one of them, so one necessary token is enough:
the window's rarest shingle, counted over all documents. Documents meet windows on that token alone; bounds on
length and position cut pairs that can't fit, and the words themselves decide.

Steps. (1) A bit table of the items' shingles goes to all tasks: `SPARE` bits a shingle, but 2^`MOST_BITS` (16 MB) at
most, whatever the benchmark. (2) One pass over the documents keeps each maximal run of positions whose shingles are in
the table and that is long enough for some window; for clean documents that is nothing. (3) The positions of the runs,
without their words, meet windows on the rarest shingle; what fits in length and position is handed back to its run and
compared there word by word. A run of L words is L narrow rows and one row of L words, never L rows of L words, so a
whole long document may be a hit. Everything after (2) stays in Spark SQL.

Defined cases: a null or empty text has no words and no hit; a null or empty item has no window; rows repeating a
doc_id are each judged and returned; items repeating an item_id count once; very long texts are whole; empty tables
give empty or clean results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from postern.llm.batches import ALNUM, U64, grams, inside, owners, per_document, slices, split_words, word_hashes
from postern.session import stage

WINDOW = 10
SHINGLE = 3
#: Bits of the table for each distinct shingle of the items, and the least and most bits in all, as powers of two.
SPARE, LEAST_BITS, MOST_BITS = 64, 20, 27

_RUN = StructType(
    [
        StructField("size", IntegerType()),
        StructField("start", IntegerType()),
        StructField("words", ArrayType(StringType())),
        StructField("tokens", ArrayType(LongType())),
    ]
)


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: item, shingle size, words and shingle tokens."""
    out = StructType([StructField("item", items.schema[item_id].dataType), *[f for f in _RUN.fields if f.name != "start"]])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in slices(blobs):
                rows = []
                for item, blob in zip(ids[lo:hi], blobs[lo:hi]):
                    words = (blob or b"").translate(ALNUM).split()
                    width, size = min(window, len(words)), min(shingle, len(words))
                    if words:
                        tokens = grams(word_hashes(words), size).view(np.int64).tolist()
                        names = [w.decode() for w in words]
                        rows += [{"item": item, "size": size, "words": names[i : i + width], "tokens": tokens[i : i + width - size + 1]} for i in range(len(words) - width + 1)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return items.select(item_id, text).mapInArrow(run, out).distinct()


def _table(found: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the windows' tokens: at most 2^bits / 64 rows reach the driver."""
    rows = (
        found.select(F.explode("tokens").alias("t"))
        .select(F.shiftrightunsigned("t", 64 - bits).alias("b"))
        .select(F.floor(F.col("b") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(b % 64 AS int))").alias("v"))
        .groupBy("w")
        .agg(F.bit_or("v").alias("v"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return table.view(U64)


def table_bits(found: DataFrame) -> int:
    """Size of the bit table as a power of two."""
    n = found.select(F.explode("tokens").alias("t")).agg(F.approx_count_distinct("t")).first()[0]
    return min(MOST_BITS, max(LEAST_BITS, (SPARE * n).bit_length()))


def runs(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Per document: the `keep` columns, n_words and the runs of words that could hold a window."""
    bits = table_bits(found) if bits is None else bits
    least = {r["size"]: r["n"] for r in found.groupBy("size").agg(F.min(F.size("words")).alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(_table(found, bits))
    shift = U64(64 - bits)

    def kernel(blobs: list[bytes | None]) -> list:
        words, counts = split_words(blobs, ALNUM)
        base = np.cumsum(counts) - counts
        owner, hashes = owners(counts), word_hashes(words)
        rows: list[list[dict]] = [[] for _ in blobs]
        for size, shortest in least.items():
            h = grams(hashes, size)
            bit = h >> shift
            hit = (table.value[bit >> U64(6)] >> (bit & U64(63))) & U64(1) == 1
            hit &= inside(owner, size)
            at = np.flatnonzero(hit)
            if len(at) == 0:
                continue
            new = np.r_[True, (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])]
            first, last = at[new], at[np.r_[new[1:], True]]
            for a, z in zip(first.tolist(), last.tolist()):
                if z - a + size >= shortest:
                    d = int(owner[a])
                    rows[d].append({"size": size, "start": a - int(base[d]), "words": [w.decode() for w in words[a : z + size]], "tokens": h[a : z + 1].view(np.int64).tolist()})
        return [counts, rows]

    return per_document(docs, [doc_id, *keep], text, kernel, [StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN))])


def hits(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(documents with the `keep` columns, n_words and a row key, occurrences: row key, start word, n words, item)."""
    found = stage(windows(items, item_id, "text", window, shingle))
    kept = stage(runs(docs, found, doc_id, text, keep=keep).withColumn("_row", F.monotonically_increasing_id()))
    run = kept.select("_row", F.posexplode("runs").alias("run", "r"))
    place = run.select("_row", "run", F.size("r.words").alias("length"), F.col("r.size").alias("size"), F.posexplode("r.tokens").alias("k", "token"))
    counts = place.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    spread = found.select("item", "words", "size", F.posexplode("tokens").alias("offset", "token"))
    rarest = (
        spread.join(counts, "token", "left")
        .groupBy("item", "words", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("m"))
        .where(F.col("m.n") > 0)
        .select("item", F.col("words").alias("want"), F.col("size").alias("of"), F.col("m.token").alias("token"), F.col("m.offset").alias("offset"))
    )
    at = F.col("k") - F.col("offset")
    near = place.join(rarest, "token").where((F.col("size") == F.col("of")) & (at >= 0) & (at + F.size("want") <= F.col("length")))
    tried = near.groupBy("_row", "run").agg(F.collect_list(F.struct(at.alias("at"), "want", "item")).alias("tried"))
    same = F.filter("tried", lambda c: F.slice(F.col("r.words"), c["at"] + 1, F.size(c["want"])) == c["want"])
    exact = run.join(tried, ["_row", "run"]).select("_row", F.col("r.start").alias("first"), F.explode(same).alias("c"))
    return kept.drop("runs"), exact.select("_row", (F.col("first") + F.col("c.at")).alias("start"), F.size("c.want").alias("n"), F.col("c.item").alias("item"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per document: n_words, spans (start, n) of the windows found, and the items they belong to, sorted as strings."""
    rows, found = hits(docs, items, doc_id, text, item_id, window, shingle)
    per = found.groupBy("_row").agg(
        F.collect_set(F.struct("start", "n")).alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    return rows.join(per, "_row", "left").select(
        doc_id, "n_words", F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of `decontaminate`: words hit, items, digest of the items."""
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    return found.select(
        doc_id,
        "n_words",
        F.size(covered).cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
