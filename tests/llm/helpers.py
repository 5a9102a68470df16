"""Small tables with every odd case, for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

SPACE = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, spans string, ids string"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def prose(n, seed, words="the of and river stone light house quiet Morning. walk, tree wind paper voice glass winter summer".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


def odd_texts():
    """Null, empty, white space, exotic spaces, one word, long, repeated, copies."""
    long = prose(9000, 1)
    base = prose(120, 2)
    near = base.split(" ")
    near[60] = "changed"
    passage = prose(50, 3)
    return [
        None, "", " \n\t ", "word", "two words", "été ßtraße 日本語 \u0085 x", long, base, base, " ".join(near), passage + " " + prose(40, 4),
        prose(30, 5) + "\n" + passage, "a b c " * 40, "x" * 5000, passage[: len(passage) // 2], "line one here\nline one here\n\nline one here",
    ]


def documents(spark, texts=None, dup=True):
    """Columns that clash with the operators' own, a null id, and a row given twice."""
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 else "s", None, "x", "y", "z") for i, t in enumerate(texts)]
    if dup and rows:
        rows += [rows[-1], (None, texts[0], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ordered(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
