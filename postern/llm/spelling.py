"""Spelling variants: words that differ by one code point, found with asymmetric q-chunks.

1. Words. Each text's maximal runs of Latin letters, A-Z in lower case; a run whose checksum with its document's id is
   divisible by `NOISE` loses one code point. Counted per task, summed over all documents.
2. Chunks. Of two near words the longer one (of equal lengths the greater) contributes two disjoint chunks, its first and
   its last half; one edit leaves one of them whole. The other contributes its positional grams of that length; since it
   is as long or one shorter, a chunk can only stand in it at shift zero or one, so the grams at all other positions are
   never written. What lies beside the whole half again differs by exactly one edit, so the same step is taken there:
   a key is a half and half of the rest, three quarters of a word. That is what keeps a common ending from
   meeting itself: no rows are dropped and no group is capped.
3. Words that share a key are verified by their edit distance, each pair once.
4. A word's form is its near word of largest count (ties: smallest in code-point order) if that is at least `FACTOR`
   times as frequent as the word; the root follows forms to the last one, by pointer jumping, since counts only grow.

Defined cases: null and empty texts have no words; a null doc_id is written as nothing before the colon; rows repeating a
document count again; a text of any length is read whole; ties are broken by code points; an empty table gives no rows.
Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.llm.batches import LOWER
from postern.session import stage

NOISE = 199
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Words a task remembers before it hands on their counts.
REMEMBERED = 400_000


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, noise: int = NOISE) -> DataFrame:
    """(word, n) of all words of at least `least` code points; shorter runs can't become one of them."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def flush(counts: Counter[str]) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for who, blob in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = Counter(runs.findall((blob or b"").translate(LOWER).decode()))
                start = crc32(f"{'' if who is None else who}:".encode())
                for word in list(own):
                    h = crc32(word.encode(), start)
                    if h % noise == 0:
                        n, at = own.pop(word), h % len(word)
                        if len(word) > least:
                            counts[word[:at] + word[at + 1 :]] += n
                counts.update(own)
                if len(counts) > REMEMBERED:
                    yield flush(counts)
        yield flush(counts)

    return docs.select(doc_id, text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(s: Column, size: Column, q: Column, head: bool) -> tuple[Column, Column]:
    """First or last q code points of s, and the rest."""
    if head:
        return F.substring(s, F.lit(1), q), F.substring(s, q + 1, size)
    return F.substring(s, size - q + 1, q), F.substring(s, F.lit(1), size - q)


def _keys(word: Column, size: Column, of: Column) -> list[Column]:
    """Keys under which `word` meets words of `of` code points: which half, the half, which half of the rest, that half."""
    out = []
    q = F.floor(of / 2).cast("int")
    k = F.floor((of - q) / 2).cast("int")
    for head in (True, False):
        half, rest = _cut(word, size, q, head)
        for first in (True, False):
            out.append(F.xxhash64(of, F.lit(head), half, F.lit(first), _cut(rest, size - q, k, first)[0]))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(x, x_n, y, y_n): pairs of words at edit distance one, each once; x is the longer, or of equal lengths the greater."""
    sized = words.withColumn("size", F.length("word"))
    w, size = F.col("word"), F.col("size")
    chunks = sized.select(F.explode(F.array(*_keys(w, size, size))).alias("key"), F.col("word").alias("x"), F.col("n").alias("x_n"), size.alias("x_size"))
    grams = sized.select(
        F.explode(F.array(*_keys(w, size, size), *_keys(w, size, size + 1))).alias("key"), F.col("word").alias("y"), F.col("n").alias("y_n"), size.alias("y_size")
    )
    met = chunks.join(grams, "key").where(((F.col("x_size") == F.col("y_size") + 1) | ((F.col("x_size") == F.col("y_size")) & (F.col("x") > F.col("y")))))
    return met.where(F.levenshtein("x", "y", 1) == 1).select("x", "x_n", "y", "y_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: forms followed to the last, twice as far in each round."""
    reach = stage(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        ahead = reach.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = stage(reach.join(ahead, reach["root"] == ahead["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reach = step.drop("moved")
        if step.where("moved").isEmpty():
            return reach


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, noise: int = NOISE
) -> DataFrame:
    """Per word: n, n_near (near words), form and form_n (null without one), root (the word itself without a form)."""
    words = stage(counted_words(docs, doc_id, text, least, noise).where(F.col("n") >= least_count))
    pairs = stage(near_pairs(words))
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("y_n").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("y").alias("word"), F.col("x").alias("other"), F.col("x_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= factor * F.col("n")
    found = stage(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
        )
    )
    last = roots(found)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
