"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of lower-cased texts per language in one pass over all labelled rows; each
task adds up a dense vector per language, so the shuffle holds at most languages x BUCKETS counts a task. The table
of log probabilities (languages x BUCKETS numbers, its size set by the parameters) is broadcast; a document's score
is the sum of the rows of its n-grams, done in numpy over bounded pieces of text.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows without a language don't train;
without any training row every text is `und`; rows repeating a doc_id are each predicted; texts count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from postern.llm.batches import per_document, slices

BUCKETS, SIZES, ALPHA = 1 << 16, (1, 2, 3), 0.5
#: Characters worked on at a time.
PIECE = 1 << 18
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    weight: np.ndarray


def features(text: str, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of ` text ` in lower case, a bounded piece of text at a time."""
    text, over = f" {text.lower()} ", max(sizes) - 1
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE + over].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in sizes:
            size = min(PIECE, len(code) - n + 1)
            if size <= 0:
                continue
            h = np.full(size, n, np.uint64)
            for j in range(n):
                h = (h ^ code[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h % np.uint64(buckets)).astype(np.int64)


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """Documents (bucket -1) and n-grams by language and bucket, over all rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            blobs, langs = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            for blob, name in zip(blobs, langs):
                own = seen.setdefault(name, np.zeros(buckets + 1, np.int64))
                own[-1] += 1
                for h in features(blob.decode(), sizes, buckets):
                    own[:-1] += np.bincount(h, minlength=buckets) if len(h) > buckets // 8 else 0
                    if len(h) <= buckets // 8:
                        np.add.at(own, h, 1)
        for name, own in seen.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at)), "bucket": np.where(at == buckets, -1, at), "n": own[at]})

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    return rows.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS, alpha: float = ALPHA) -> Model:
    """Log probabilities with additive smoothing. The driver gets languages x buckets counts at most."""
    found = counts(docs, text, lang, sizes, buckets).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    table, number = np.zeros((len(names), buckets)), np.zeros(len(names))
    who = np.fromiter((place[x] for x in found.column("lang").to_pylist()), np.int64, found.num_rows)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    table[who[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    number[who[bucket < 0]] = n[bucket < 0]
    weight = np.log(table + alpha) - np.log(table.sum(1, keepdims=True) + alpha * buckets)
    return Model(names, np.log(number / max(1.0, number.sum())), np.ascontiguousarray(weight.T))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> DataFrame:
    """The `keep` columns with lang_pred and score, the posterior probability of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(blobs: list[bytes | None]) -> list:
        m = shared.value
        sums, known = np.zeros((len(blobs), len(m.langs))), np.zeros(len(blobs), bool)
        for d, blob in enumerate(blobs):
            value = blob.decode() if blob and m.langs else ""
            if not value or not _LETTER.search(value):
                continue
            known[d] = True
            sums[d] = m.prior
            for h in features(value, sizes, buckets):
                sums[d] += m.weight.take(h, axis=0).sum(0)
        if not m.langs:
            return [[UNKNOWN] * len(blobs), [0.0] * len(blobs)]
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        return [[m.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, share, 0.0)]

    return per_document(docs, keep, text, kernel, [StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo `folds`."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on three quarters of the rows, predict all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(doc_id)), text, lang)
    return predict(docs, model, [doc_id], text).select(doc_id, held_out(doc_id).alias("held_out"), "lang_pred", "score")
