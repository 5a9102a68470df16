"""Arrow batches of documents: bounded slices in, columns out. Shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of text a kernel works on at a time (one longer document is worked on alone).
SLICE_BYTES = 1 << 20

U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)

#: Lower-cases A-Z and blanks every other ASCII character that is not a letter or digit.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def slices(blobs: Sequence[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of at most `limit` bytes together, or of one document."""
    lo = size = 0
    for i, blob in enumerate(blobs):
        n = len(blob) if blob else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(blobs):
        yield lo, len(blobs)


def per_document(
    docs: DataFrame,
    keep: Sequence[str],
    text: str,
    kernel: Callable[..., list],
    fields: Sequence[StructField],
    limit: int = SLICE_BYTES,
    beside: Sequence[str] = (),
) -> DataFrame:
    """One row per document: the `keep` columns, then what `kernel` makes of a slice's UTF-8 texts, a column per field.

    The kernel is also given the values of each column of `beside`. Only `keep`, `text` and `beside` are read, so further columns of `docs` can't clash with the fields.
    """
    out = StructType([docs.schema[c] for c in keep] + list(fields))
    arrow = to_arrow_schema(out)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(k).cast(pa.binary()).to_pylist()
            more = [batch.column(k + 1 + j).to_pylist() for j in range(len(beside))]
            for lo, hi in slices(blobs, limit):
                made = kernel(blobs[lo:hi], *[x[lo:hi] for x in more])
                columns = [batch.column(j).slice(lo, hi - lo) for j in range(k)]
                columns += [c if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(k + j).type) for j, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(*[docs[c] for c in keep], docs[text], *[docs[c] for c in beside]).mapInArrow(run, out)


class WordHash(dict):
    """64-bit hash of each word; remembers a bounded number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


_WORD_HASH = WordHash()


def split_words(blobs: Sequence[bytes | None], table: bytes | None = None) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts one after another, and the number of words of each.

    Without a table words end at ASCII white space alone; a table (ALNUM, LOWER) is applied first.
    """
    words: list[bytes] = []
    counts = np.zeros(len(blobs), np.int64)
    for i, blob in enumerate(blobs):
        if blob:
            own = (blob.translate(table) if table else blob).split()
            counts[i] = len(own)
            words += own
    return words, counts


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return _WORD_HASH.of(words)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit mix of two hash arrays."""
    x = a * _K1 + (b ^ (b >> U64(29))) * _K2
    x ^= x >> U64(32)
    x *= _K3
    x ^= x >> U64(29)
    return x


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries, by doubling: n is put together from its powers of two."""
    if len(h) < n:
        return h[:0]
    out, have, power, width = None, 0, h, 1
    while True:
        if n & width:
            if out is None:
                out, have = power, width
            else:
                m = len(h) - (have + width) + 1
                out, have = mix(out[:m], power[have : have + m]), have + width
        if have == n:
            return out
        power, width = mix(power[: len(power) - width], power[width:]), width * 2


def owners(counts: np.ndarray) -> np.ndarray:
    """Index of its document for each word."""
    return np.repeat(np.arange(len(counts)), counts)


def inside(owner: np.ndarray, n: int) -> np.ndarray:
    """For each start of n consecutive words: do all lie in one document?"""
    return owner[: len(owner) - n + 1] == owner[n - 1 :] if len(owner) >= n else np.zeros(0, bool)


def split_at(values: Sequence, counts: np.ndarray) -> list:
    """Cut a flat sequence into runs of the given lengths."""
    ends = np.cumsum(counts)
    return [values[e - c : e] for e, c in zip(ends.tolist(), counts.tolist())]


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list for each document, from flat values and the number of each document's."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values)


def distinct_by_owner(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs in that order, and how often each occurs."""
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])] if len(o) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return o[first], v[first], np.diff(np.r_[first, len(o)])


def sliding(h: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each n consecutive entries, by doubling."""
    if len(h) < n:
        return h[:0]
    width = 1
    while width * 2 <= n:
        h = pick(h[: len(h) - width], h[width:])
        width *= 2
    if width == n:
        return h
    m = len(h) - (n - width)
    return pick(h[:m], h[n - width :])
