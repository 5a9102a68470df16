"""Quality rules: hard text rules, then divergence of each document from language references.

References are learned from all documents with a language: one histogram of character classes and one of common
words for each language. The common words of the languages of `COMMON` are given; those of any other language are the
`LEARNED` most frequent words of its documents. Such a language has a reference from `LEAST_LEARNED` entries on, so a
handful of mislabelled texts makes none. A document whose language has no reference is judged by the hard rules
alone; any other, also one without a language, is compared to every reference with the Jensen-Shannon distance
(base 2, so 0 to 1) and judged by the nearest, so a wrong language label does no harm. Two guards keep short texts
from being judged by sampling noise: a histogram of fewer than `LEAST` entries is not judged, and the allowed
distance is widened by the expected distance of a true sample of that size, which shrinks with its root.

Languages outside `COMMON` are learned up to `LANGUAGES`, those of most documents; further values of the language column,
often dirt, have no reference. Their words are counted by (language, word), of which `LEARNED` a language reach the
driver. The next pass adds the histograms up in each task, so the shuffle holds a few hundred numbers a task and
language; the table of references has a fixed bound and is sent to the last pass, which compares a document to each
reference over the words it has, not over all that are counted. Documents are never shuffled.

Defined cases: a null or empty text has no words and fails the hard rules; without any reference only the hard
rules judge; rows repeating a doc_id are each judged; texts count whole; only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField

from postern.llm.batches import U64, grams, inside, mix, owners, per_document, slices, split_words

# Very common words of each language that has a reference.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass kann sie nach wird bei einer um am sind noch wie einem über".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ou on aux mais comme sa ses cette nous été leur".split(),
    "it": "di e il la che in a per un è una del non i si con le da al come dei sono più nel della gli ma alla lo".split(),
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog naar heeft".split(),
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das seu sua ou quando".split(),
}

MIN_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 20, 8, 30
#: Entries a histogram needs to be judged: characters, words.
LEAST = (200, 40)
#: Allowed distance of the character classes and of the common words, and the widening by 1 / sqrt(entries).
ALLOWED, WIDEN = (0.16, 0.06), (2.3, 3.3)

#: Words learned of each language outside COMMON, and the entries its reference needs: characters, words.
LEARNED, LEAST_LEARNED = 40, (10_000, 1_000)
#: Languages outside COMMON that can have a reference.
LANGUAGES = 64

SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

CLASSES = ("lower", "upper", "digit", "space", "line", "mark", "symbol", "other", "control")
_CONTINUED = len(CLASSES)


def _class_of(c: int) -> int:
    ch = chr(c)
    if c >= 0x80:
        return _CONTINUED if c < 0xC0 else CLASSES.index("other")
    if "a" <= ch <= "z" or "A" <= ch <= "Z":
        return CLASSES.index("lower" if ch >= "a" else "upper")
    if "0" <= ch <= "9":
        return CLASSES.index("digit")
    if ch in " \t":
        return CLASSES.index("space")
    if ch in "\n\r\v\f":
        return CLASSES.index("line")
    if c < 0x20 or c == 0x7F:
        return CLASSES.index("control")
    return CLASSES.index("mark" if ch in ".,;:!?'\"()-" else "symbol")


CLASS_OF = np.array([_class_of(c) for c in range(256)], np.int32)
WORDS = sorted({w for words in COMMON.values() for w in words})


def places(words: list[str]) -> dict[bytes, int]:
    """Place in the common-word histogram of each common word, in lower case or capitalised, alone or before one mark."""
    return {(form + mark).encode(): i for i, w in enumerate(words) for form in (w, w.capitalize()) for mark in ("", *".,;:!?")}


PLACES = places(WORDS)


class References(dict):
    """Both histograms by language, and the place of each word they count."""

    def __init__(self, found: dict[str, tuple[np.ndarray, np.ndarray]], words: list[str]):
        super().__init__(found)
        self.words = words

    def __reduce__(self):
        return References, (dict(self), self.words)


def word_ids(words: list[bytes]) -> np.ndarray:
    """Small integers, equal for equal words."""
    seen = defaultdict(count().__next__)
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def _spread(ids: np.ndarray) -> np.ndarray:
    """Integers as well-mixed 64-bit values."""
    x = (ids.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    return (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)


def repeated_words(ids: np.ndarray, owner: np.ndarray, n_docs: int, width: int = REPEAT_WORDS) -> np.ndarray:
    """Per document the words inside windows of `width` words that stand in it twice or more."""
    if len(ids) < width:
        return np.zeros(n_docs, np.int64)
    at = np.flatnonzero(inside(owner, width))
    key = mix(grams(_spread(ids), width)[at], _spread(owner[at]))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + width, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def histograms(blobs: list[bytes | None], words: list[bytes], n_words: np.ndarray, at: dict[bytes, int] = PLACES, size: int = len(WORDS)) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and common words of each text, a row per document."""
    n, k = len(blobs), len(CLASSES) + 1
    raw = np.frombuffer(b"".join(b or b"" for b in blobs), np.uint8)
    place = CLASS_OF[raw]
    place += np.repeat(np.arange(0, n * k, k, dtype=np.int32), [len(b or b"") for b in blobs])
    classes = np.bincount(place, minlength=n * k).reshape(n, k)[:, :-1]
    k = size + 1
    common = np.bincount(owners(n_words) * k + np.fromiter(map(at.get, words, repeat(size)), np.int64, len(words)), minlength=n * k).reshape(n, k)
    return classes, common


@dataclass
class Measured:
    """Counts of a slice of documents; `classes` and `common` are histograms, a row per document."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray
    common: np.ndarray


def measure(blobs: list[bytes | None], at: dict[bytes, int] = PLACES, size: int = len(WORDS)) -> Measured:
    n = len(blobs)
    words, n_words = split_words(blobs)
    symbols, dup_lines, blank = (np.zeros(n, np.int64) for _ in range(3))
    for d, blob in enumerate(blobs):
        if not blob:
            continue
        symbols[d] = len(blob) - len(blob.translate(None, SYMBOLS))
        blank[d] = len(blob) - len(blob.translate(None, SPACE))
        lines = blob.split(b"\n")
        if len(lines) != len(set(lines)):
            lines = [x for x in lines if x.strip()]
            dup_lines[d] = len(lines) - len(set(lines))
    classes, common = histograms(blobs, words, n_words, at, size)
    repeats = repeated_words(word_ids(words), owners(n_words), n)
    return Measured(n_words, classes.sum(1) - blank, symbols, dup_lines, repeats, classes, common)


def distances(own: np.ndarray, references: list[np.ndarray]) -> np.ndarray:
    """Jensen-Shannon distance of each row's histogram to each reference (reference, row); 0 for an empty row.

    Only entries that a row has are looked at: of the rest, a reference's share counts whole.
    """
    n = len(own)
    row, entry = np.nonzero(own)
    total = own.sum(1)
    p = own[row, entry] / total[row]
    out = np.zeros((len(references), n))
    for i, reference in enumerate(references):
        q = (reference / max(1, reference.sum()))[entry]
        twice = p + q
        with np.errstate(divide="ignore", invalid="ignore"):
            both = p * np.log2(2 * p / twice) + np.where(q > 0, q * np.log2(2 * q / twice), 0)
        rest = (reference.sum() > 0) - np.bincount(row, q, n)
        out[i] = np.where(total > 0, np.sqrt(np.clip((np.bincount(row, both, n) + rest) / 2, 0, 1)), 0.0)
    return out


def learned_languages(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = LANGUAGES) -> list[str]:
    """The languages outside COMMON of most documents, `most` at most."""
    rows = docs.where(~F.col(lang).isin(sorted(COMMON)) & F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang")).count()
    return [r["lang"] for r in rows.orderBy(F.desc("count"), "lang").limit(most).collect()]


def learned_words(docs: DataFrame, languages: list[str], text: str = "text", lang: str = "lang") -> list[str]:
    """The LEARNED most frequent words of each of these languages, one mark at their end aside."""
    rows = docs.where(F.col(lang).isin(languages) & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.lower(text).alias("text"))
    words = rows.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).select("lang", F.regexp_replace("word", "[.,;:!?]$", "").alias("word"))
    counts = words.where("word <> ''").groupBy("lang", "word").count()
    first = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    return [r["word"] for r in counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= LEARNED).select("word").distinct().collect()]


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """Histograms of all documents of each language that may have one: a row of numbers for each reaches the driver."""
    k, others = len(CLASSES), learned_languages(docs, text, lang)
    vocabulary = WORDS + sorted(set(learned_words(docs, others, text, lang) if others else []) - set(WORDS))
    at, size = places(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            blobs, langs = batch.column(0).cast(pa.binary()).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lo, hi in slices(blobs):
                table = np.hstack(histograms(blobs[lo:hi], *split_words(blobs[lo:hi]), at, size))
                for name in set(langs[lo:hi]):
                    part = table[langs[lo:hi] == name].sum(0)
                    sums[name] = sums[name] + part if name in sums else part
        for name, row in sums.items():
            own = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(own), "place": own, "n": row[own]})

    rows = docs.where(F.col(lang).isin([*COMMON, *others]) & F.col(text).isNotNull()).select(text, lang)
    found = rows.mapInArrow(run, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()
    out = {r["lang"]: np.zeros(k + size + 1) for r in found}
    for r in found:
        out[r["lang"]][r["place"]] = r["n"]
    refs = {name: (row[:k], row[k:]) for name, row in sorted(out.items())}
    enough = {name for name, own in refs.items() if name in COMMON or all(h.sum() >= least for h, least in zip(own, LEAST_LEARNED))}
    return References({name: own for name, own in refs.items() if name in enough}, vocabulary)


FIELDS = [
    *[StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    StructField("base_failed", BooleanType()),
    StructField("kept", BooleanType()),
    StructField("nearest", StringType()),
    StructField("class_distance", DoubleType()),
    StructField("word_distance", DoubleType()),
]


def _kernel(refs: References) -> Callable[[list[bytes | None], list[str | None]], list]:
    names = list(refs) or [None]
    at, size = places(refs.words), len(refs.words)

    def kernel(blobs: list[bytes | None], langs: list[str | None]) -> list:
        m = measure(blobs, at, size)
        failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > REPEAT_PERCENT * m.n_words)
        sizes = np.stack([m.classes.sum(1), m.common.sum(1)])
        far = np.zeros((len(names), 2, len(blobs)))
        if refs:
            far = np.stack([distances(own, list(known)) for own, known in zip((m.classes, m.common), zip(*refs.values()))], 1)
        allowed = np.array(ALLOWED)[:, None] + np.array(WIDEN)[:, None] / np.sqrt(np.maximum(1, sizes))
        best = (far / allowed).max(1).argmin(0)
        mine = far[best, :, np.arange(len(blobs))]
        judged = sizes >= np.array(LEAST)[:, None]
        bad = (judged & (mine.T > allowed)).any(0) & np.array([x is None or x in refs for x in langs], bool)
        return [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, ~failed & ~bad, [names[b] for b in best], mine[:, 0], mine[:, 1]]

    return kernel


def judge(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", refs: References | None = None) -> DataFrame:
    """The `keep` columns, the counts, base_failed, kept, and the nearest reference with both distances."""
    return per_document(docs, keep, text, _kernel(references(docs, text, lang) if refs is None else refs), FIELDS, beside=[lang])


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang", refs: References | None = None) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns."""
    kernel, at, tag = _kernel(references(docs, text, lang) if refs is None else refs), docs.columns.index(text), docs.columns.index(lang)
    verdict = [f.name for f in FIELDS].index("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, langs = batch.column(at).cast(pa.binary()).to_pylist(), batch.column(tag).to_pylist()
            for lo, hi in slices(blobs):
                yield batch.slice(lo, hi - lo).filter(pa.array(kernel(blobs[lo:hi], langs[lo:hi])[verdict]))

    return docs.mapInArrow(run, docs.schema)
