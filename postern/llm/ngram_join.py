"""N-gram Jaccard join: rare-first prefix filtering, and groups of linked documents.

A document's set holds its distinct word n-grams. Two sets link when 100 * |intersection| >= percent * |union|.

1. Order. All n-grams are counted over all documents in a table of fixed size (`BUCKETS` counters by hash, 2 MB, sent
   to all tasks). The order (count, hash) is the same everywhere, so filters on it are exact; a collision only makes
   an n-gram look more common.
2. Classes. Documents with equal sets (128-bit sum and mix of the set) are one class, named by its smallest doc_id.
3. Prefixes. If two sets link, they share an n-gram among the first n - ceil(percent * n / 100) + 1 of either in that
   order. Classes meet on these tokens alone, which for most documents are their own and meet nothing.
4. Pairs, without all pairs of a group: each token's classes first meet only its centre, the class in which it stands
   earliest (fewest n-grams of its own). Then components are taken, and only classes that share a token but lie in
   different components still meet. Links inside a component can't change the result, so nothing is lost.
   Of consecutive common tokens a pair meets on the first alone.
5. Filters per pair, on its first common token: length, position (what can still follow in either set), and suffix
   (sets cut into `CELLS` cells by hash: the differences of the cells' sizes bound the sets' difference from below).
6. Each remaining pair is verified once, on the two texts.

Components: rounds of large-star and small-star until nothing changes, each written to the shared folder.

Defined cases: a document of fewer than n words has its whole sequence as one n-gram; without words (null, empty) it
links with nothing and is its own component; rows repeating a doc_id are one document, linked with itself, and all
returned; a row without a doc_id is returned without component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from postern.llm.batches import LOWER, U64, distinct_by_owner, grams, inside, lists, mix, owners, per_document, slices, split_words, word_hashes
from postern.session import stage

NGRAM, PERCENT = 4, 85
BUCKET_BITS, CELLS = 18, 64


def gram_sets(blobs: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text: (document, hash), documents ascending."""
    words, counts = split_words(blobs, LOWER)
    owner, h = owners(counts), word_hashes(words)
    at = np.flatnonzero(inside(owner, n))
    who, what = owner[at], grams(h, n)[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        base = np.cumsum(counts) - counts
        own = [grams(h[base[d] : base[d] + counts[d]], int(counts[d])) for d in short]
        who, what = np.r_[who, short], np.concatenate([what, *own])
    return distinct_by_owner(who, what)[:2]


def bucket_counts(docs: DataFrame, text: str, n: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """Documents' n-grams counted by bucket, over all documents: at most 2^bits rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            blobs = batch.column(0).cast(pa.binary()).to_pylist()
            for lo, hi in slices(blobs):
                total += np.bincount((gram_sets(blobs[lo:hi], n)[1] >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"b": at, "n": total[at]})

    found = docs.select(text).mapInArrow(run, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << bits, np.int64)
    table[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return table


def prefix_rows(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, bits: int = BUCKET_BITS) -> DataFrame:
    """Per document: set size, two digests of the set, prefix tokens in rare-first order, cell sizes."""
    table = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, text, n, bits))

    def kernel(blobs: list[bytes | None]) -> list:
        k = len(blobs)
        who, h = gram_sets(blobs, n)
        size = np.bincount(who, minlength=k)
        one, two = np.zeros(k, U64), np.zeros(k, U64)
        np.add.at(one, who, mix(h, h >> U64(7)))
        np.add.at(two, who, mix(h >> U64(3), h))
        order = np.lexsort((h, table.value[(h >> U64(64 - bits)).astype(np.int64)], who))
        place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        length = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
        prefix = h[order][place < np.repeat(length, size)]
        cells = np.bincount(who * CELLS + (h % U64(CELLS)).astype(np.int64), minlength=k * CELLS)
        return [size, one.view(np.int64), two.view(np.int64), lists(length, pa.array(prefix.view(np.int64))), lists(np.full(k, CELLS), pa.array(cells, pa.int32()))]

    longs = [StructField(c, LongType()) for c in ("size", "one", "two")]
    return per_document(docs, [doc_id], text, kernel, [*longs, StructField("prefix", ArrayType(LongType())), StructField("cells", ArrayType(IntegerType()))])


def _least_overlap(percent: int) -> Column:
    """Smallest intersection that links sets of sizes x_size and y_size."""
    return F.ceil((F.col("x_size") + F.col("y_size")) * percent / F.lit(100 + percent))


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of (x, y, sizes, positions) rows that pass the length and position filters on their first common token."""
    long, short = F.greatest("x_size", "y_size"), F.least("x_size", "y_size")
    first = met.where(100 * short >= percent * long).groupBy("x", "y", "x_size", "y_size").agg(F.min("x_at").alias("x_at"), F.min("y_at").alias("y_at"))
    rest = 1 + F.least(F.col("x_size") - F.col("x_at") - 1, F.col("y_size") - F.col("y_at") - 1)
    return first.where(rest >= _least_overlap(percent)).drop("x_at", "y_at")


def _suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    cells = classes.select("node", "size", "cells")
    x = cells.toDF("x", "x_size", "x_cells")
    y = cells.toDF("y", "y_size", "y_cells")
    apart = F.aggregate(F.zip_with("x_cells", "y_cells", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
    both = pairs.join(x, ["x", "x_size"]).join(y, ["y", "y_size"])
    return both.where(apart <= F.col("x_size") + F.col("y_size") - 2 * _least_overlap(percent)).select("x", "y").distinct()


def verify(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose texts link, each pair's sets compared once."""
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = pairs.join(texts.toDF("x", "x_text"), "x").join(texts.toDF("y", "y_text"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, U64))
        for batch in batches:
            left, right = (batch.column(j).cast(pa.binary()).to_pylist() for j in (2, 3))
            good = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(left, right)):
                if b != seen[0]:
                    seen = b, gram_sets([b], n)[1]
                own = gram_sets([a], n)[1]
                common = len(np.intersect1d(own, seen[1], assume_unique=True))
                good[i] = 100 * common >= percent * (len(own) + len(seen[1]) - common)
            yield pa.RecordBatch.from_arrays([batch.column(j).filter(pa.array(good)) for j in (0, 1)], names=["x", "y"])

    kind = dict(pairs.dtypes)["x"]
    return rows.select("x", "y", "x_text", "y_text").mapInArrow(run, f"x {kind}, y {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (x, y); the root is the smallest node of its component."""
    edges = stage(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    mark: Callable[[DataFrame], tuple] = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        # Large star: every neighbour above a node is tied to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every neighbour below a node, and the node, are tied to the smallest of them.
        large = stage(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.toDF("u", "v"))
        edges = stage(tied.where("u <> v").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("v")).toDF("node", "root")


def link_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    rows = stage(prefix_rows(docs, doc_id, text, n, percent).withColumnRenamed(doc_id, "id"))
    named = rows.where(F.col("id").isNotNull() & (F.col("size") > 0))
    key = ["size", "one", "two"]
    classes = stage(named.groupBy(*key).agg(F.min(F.struct(F.col("id").alias("node"), "prefix", "cells")).alias("c")).select(*key, "c.node", "c.prefix", "c.cells"))

    tokens = classes.select("node", "size", F.posexplode("prefix").alias("at", "token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "node", "size")).alias("centre")).where("n > 1").drop("n")
    # `known`: earlier tokens of the class that any other class has; `previous`: the last of them.
    along = Window.partitionBy("node", "size").orderBy("at")
    shared = stage(tokens.join(shared, "token").withColumns({"known": F.row_number().over(along) - 1, "previous": F.lag("token").over(along)}))
    y = F.col("centre")
    star = shared.where(F.col("node") != y["node"]).select(
        F.col("node").alias("x"), y["node"].alias("y"), F.col("size").alias("x_size"), y["size"].alias("y_size"), F.col("at").alias("x_at"), y["at"].alias("y_at")
    )
    first = stage(_suffix_filter(_candidates(star, percent), classes, percent))
    key_of = F.struct(*key)
    twice = named.groupBy("id").agg(F.min(key_of).alias("a"), F.max(key_of).alias("b")).where("a <> b").select("id")
    own = named.join(twice, "id", "left_semi").join(classes, key).select("id", "node")
    tied = own.join(own.groupBy("id").agg(F.min("node").alias("y")), "id").select(F.col("node").alias("x"), "y")
    links = stage(verify(first, docs, doc_id, text, n, percent).unionByName(tied))
    roots = stage(components(links))

    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("centre")
    mixed = placed.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token")
    open_rows = stage(placed.join(mixed, "token", "left_semi"))
    major = open_rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("major"))
    open_rows = open_rows.join(major, "token")
    side = lambda rows, s: rows.select("token", F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("size", "at", "known", "previous", "root")], (F.col("root") == F.col("major")).alias(f"{s}_in_major"))
    # What can be common before this token is known to another class, and what can follow is left in both.
    rest = 1 + F.least("x_known", "y_known") + F.least(F.col("x_size") - F.col("x_at") - 1, F.col("y_size") - F.col("y_at") - 1)
    fits = (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size")) & (rest >= _least_overlap(percent))
    # Where the tokens before are equal, the pair has met on those.
    fresh = ~F.col("x_previous").eqNullSafe(F.col("y_previous")) | F.col("x_previous").isNull()
    once = F.col("y_in_major") | (F.col("x") < F.col("y"))
    met = side(open_rows.where("root <> major"), "x").join(side(open_rows, "y"), "token").where((F.col("x_root") != F.col("y_root")) & once & fits & fresh)
    later = _suffix_filter(_candidates(met, percent), classes, percent)
    done = first.unionByName(first.select(F.col("y").alias("x"), F.col("x").alias("y")))
    more = verify(later.join(done, ["x", "y"], "left_anti"), docs, doc_id, text, n, percent)
    final = components(links.unionByName(more))

    groups = classes.select(*key, "node").join(final, "node", "left").select(*[F.col(c).alias(f"_{c}") for c in key], F.coalesce("root", "node").alias("root"))
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return rows.join(groups, same, "left").select(F.col("id").alias(doc_id), F.col("size").alias("n_shingles"), component.alias("component_id"))
