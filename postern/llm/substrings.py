"""Substring dedup by level-wise doubling.

A window of `window` words whose sequence also starts anywhere else is removed, word by word. Lengths go up by
doubling (18, then 35 for a window of 35): only windows that are repeated at one length are looked at in the next.

At the first length not every position is counted: of each stretch that a window of the next length covers, the
position with the smallest hash (a minimizer) stands for all. Which position that is depends on the words alone, so
two equal windows have equal minimizers, and no repeat is lost; about a tenth of the positions remain. They are written
once; their hashes that start in several places are joined back. From the next length on nearly all survivors are
repeated, so what is handed back are the few that are not: a hash of one place alone names its text in the same
aggregate, and no join is needed.

What a text gets back is keyed by a hash of the text itself. "Repeated" and "alone" are facts about a hash anywhere, so
rows of equal text share a list, a clash of keys does no harm, and neither null nor very common ids meet in one place. Texts
are shuffled once, for the next length and the cut together; a text that fills a third of all rows is split like any
skewed join. Hashes are 64 bits of the words' 64-bit hashes.

Defined cases: null and empty texts have no words; a text of fewer words than the window keeps all; rows repeating a
document are places of their own, so their windows are repeated; ids are only carried; a very long text is worked on
alone; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from postern.llm.batches import distinct_by_owner, grams, inside, lists, owners, per_document, slices, sliding, split_words, word_hashes
from postern.session import stage

WINDOW = 35
#: The first length is the window halved until it is at most this.
FIRST = 24

_GRAMS = ArrayType(StructType([StructField("h", LongType()), StructField("n", IntegerType())]))


def lengths(window: int, first: int = FIRST) -> list[int]:
    out = [window]
    while out[0] > first:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _counted(owner: np.ndarray, h: np.ndarray, n_docs: int) -> pa.Array:
    o, v, n = distinct_by_owner(owner, h)
    values = pa.StructArray.from_arrays([pa.array(v.view(np.int64)), pa.array(n, pa.int32())], ["h", "n"])
    return lists(np.bincount(o, minlength=n_docs), values)


def minimizers(h: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
    """Positions that hold the smallest hash of some stretch of n positions; `good` says which stretches count."""
    least = sliding(h, n, np.minimum)
    least = np.where(good[: len(least)], least, np.uint64(0))
    pad = np.zeros(n - 1, np.uint64)
    return np.flatnonzero(sliding(np.r_[pad, least, pad], n, np.maximum) == h) if len(least) else np.zeros(0, np.int64)


def _known(h: list[np.ndarray], owner: np.ndarray, steps: list[int], again: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """For each window of the last length in `steps`: are both of its halves repeated, at every length below?

    `h` has the hashes of all windows by length. `again` are the repeated minimizers of the first length, `alone` the windows
    of later lengths that start in one place only.
    """
    good = inside(owner, steps[0])
    if len(steps) == 1:
        return good & np.isin(h[0], again)
    for k in range(1, len(steps)):
        short, long = steps[k - 1], steps[k]
        n = len(h[k])
        if k == 1:
            good = inside(owner, long) & np.isin(sliding(h[0], long - short + 1, np.minimum), again)
        else:
            known = good & ~np.isin(h[k - 1], alone)
            good = inside(owner, long) & known[:n] & known[long - short : long - short + n]
    return good


def _with_sets(rows: DataFrame, sets: DataFrame, kernel: Callable, keep: list[str], fields: list[StructField], how: str) -> DataFrame:
    """A kernel over a slice's texts and the hashes listed for them (facts about a hash anywhere, so one list serves a slice)."""
    out = StructType([*[rows.schema[c] for c in keep], *fields])
    arrow = to_arrow_schema(out)

    def listed(column: pa.Array) -> np.ndarray:
        return np.unique(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(batch.schema.names, batch.columns))
            blobs = own["text"].cast(pa.binary()).to_pylist()
            for lo, hi in slices(blobs):
                made = kernel(blobs[lo:hi], listed(own["again"].slice(lo, hi - lo)), listed(own["alone"].slice(lo, hi - lo)))
                columns = [own[c].slice(lo, hi - lo) for c in keep]
                columns += [c if isinstance(c, pa.Array) else pa.array(c, arrow.field(len(keep) + j).type) for j, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

    # All columns on both uses, so that Spark deals the texts out once.
    return rows.join(sets, "key", how).select("id", "key", "text", "again", "alone").mapInArrow(run, out)


_HASHES = "array<bigint>"


def repeats(rows: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """key, again, alone: what `_known` asks for, by key of the text (columns id, key, text); other keys have no repeats."""
    steps = lengths(window, first)

    def sampled(blobs: list[bytes | None]) -> list:
        words, counts = split_words(blobs)
        owner, h = owners(counts), word_hashes(words)
        g = grams(h, steps[0])
        at = minimizers(g, inside(owner, steps[1]), steps[1] - steps[0] + 1) if len(steps) > 1 else np.flatnonzero(inside(owner, steps[0]))
        return [_counted(owner[at], g[at], len(blobs))]

    spread = lambda found: found.select("key", F.explode("grams").alias("g")).select("key", "g.h", "g.n")
    found = spread(stage(per_document(rows, ["key"], "text", sampled, [StructField("grams", _GRAMS)])))
    again = found.groupBy("h").agg(F.sum("n").alias("places")).where(F.col("places") > 1).select("h")
    nothing = F.array().cast(_HASHES)
    sets = stage(found.join(again, "h").groupBy("key").agg(F.collect_set("h").alias("again"))).withColumn("alone", nothing)
    for k in range(1, len(steps)):

        def extended(blobs: list[bytes | None], again: np.ndarray, alone: np.ndarray, upto: int = k + 1) -> list:
            words, counts = split_words(blobs)
            owner, h = owners(counts), word_hashes(words)
            by_length = [grams(h, n) for n in steps[:upto]]
            at = np.flatnonzero(_known(by_length, owner, steps[:upto], again, alone))
            return [_counted(owner[at], by_length[-1][at], len(blobs))]

        longer = spread(_with_sets(rows, sets, extended, ["key"], [StructField("grams", _GRAMS)], "inner"))
        lone = longer.groupBy("h").agg(F.sum("n").alias("places"), F.max("key").alias("key")).where(F.col("places") == 1)
        lone = lone.groupBy("key").agg(F.collect_list("h").alias("more"))
        lone = lone.select("key", nothing.alias("again"), F.col("more").alias("alone"))
        sets = sets.unionByName(lone).groupBy("key").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("again", "alone")])
        if k + 1 < len(steps):
            sets = stage(sets)
    return sets


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """Per document: n_words, n_removed and kept (the other words, joined by one space)."""
    rows = docs.select(docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("key"), docs[text].alias("text"))
    steps = lengths(window, first)

    def cut(blobs: list[bytes | None], again: np.ndarray, alone: np.ndarray) -> list:
        words, counts = split_words(blobs)
        removed = np.zeros(len(words), bool)
        gone = np.zeros(len(blobs), np.int64)
        if len(again):
            owner, h = owners(counts), word_hashes(words)
            by_length = [grams(h, n) for n in steps]
            good = _known(by_length, owner, steps, again, alone)
            at = np.flatnonzero(good & ~np.isin(by_length[-1], alone) if len(steps) > 1 else good)
            edge = np.zeros(len(words) + 1, np.int64)
            edge[at] += 1
            edge[at + window] -= 1
            removed = np.cumsum(edge[:-1]) > 0
            gone = np.bincount(owner[removed], minlength=len(blobs))
        kept, at = [], 0
        for n, g in zip(counts.tolist(), gone.tolist()):
            own = words[at : at + n]
            kept.append(b" ".join([w for w, r in zip(own, removed[at : at + n].tolist()) if not r] if g else own).decode())
            at += n
        return [counts, gone, kept]

    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    return _with_sets(rows, repeats(rows, window, first), cut, ["id"], fields, "left").withColumnRenamed("id", doc_id)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return found.select(doc_id, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
