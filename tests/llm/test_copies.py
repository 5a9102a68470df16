"""N-gram join and substring dedup against plain Python."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest

from postern.llm import ngram_join, substrings
from tests.llm.helpers import SCHEMA, SPACE, documents, lower, odd_texts, prose


def brute_components(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = SPACE.findall(lower(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_family(seed, count=40, words=90, edits=7):
    """Copies of one text with up to `edits` changed words: links that form chains, and copies too far for any."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10_000)}" for _ in range(words)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(r.randint(0, edits)):
            own[r.randrange(words)] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(own[: words - r.randint(0, 12)]))
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_match_brute_force(spark, n, percent):
    texts = [*odd_texts(), *near_family(1), *near_family(2, 25, 30, 3), "one two", "ONE two", "common line of text here", "common line of text here too", *[f"common line of text here number {i} {i}" for i in range(30)]]
    docs = documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    want = brute_components(rows, n, percent)
    out = ngram_join.link_groups(docs, n=n, percent=percent).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None
    assert max(collections.Counter(c for _, c in want.values()).values()) > 5


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "p q r s t u"), (5, "a b c d e f"), (7, "p q r s t u"), (9, "z")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.link_groups(docs).collect()} == {(1, 1), (5, 1), (7, 1), (9, 9)}


def test_long_chain_of_links_is_one_component(spark):
    r = random.Random(5)
    words = [f"v{r.randint(0, 10**6)}" for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(100)], "doc_id bigint, text string")
    assert {r.component_id for r in ngram_join.link_groups(docs).collect()} == {0}


def brute_dedup(rows, window):
    words = [SPACE.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 12, 61, 100])
def test_dedup_matches_brute_force(spark, window):
    r = random.Random(7)
    passages = [prose(r.randint(20, 90), 100 + i) for i in range(6)]
    mixed = [" ".join(r.choice([prose(r.randint(1, 40), 1000 + 10 * i + k), r.choice(passages)]) for k in range(6)) for i in range(30)]
    docs = documents(spark, [*odd_texts(), *mixed, "a b " * 30, " ".join(["same"] * 36), " ".join(["same"] * 35)])
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    got = [tuple(x) for x in substrings.digest(substrings.dedup(docs, window=window)).collect()]
    key = lambda x: tuple((y is not None, y) for y in x)
    assert sorted(got, key=key) == sorted(brute_dedup(rows, window), key=key)


def test_dedup_with_null_and_common_ids(spark):
    """Rows without an id, or with one very common id, are texts of their own; equal texts repeat each other whole."""
    texts = [*[prose(60, i) for i in range(40)], *[prose(60, i)[20:] + " " + prose(50, 900 + i) for i in range(40)], *[prose(70, 1)] * 30]
    docs = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    key = lambda x: tuple((y is not None, y) for y in x)
    for window in (35, 61):
        got = [tuple(x) for x in substrings.digest(substrings.dedup(docs, window=window)).collect()]
        assert sorted(got, key=key) == sorted(brute_dedup(rows, window), key=key)


def test_texts_are_shuffled_once(spark):
    """The next length and the cut read one exchange of the texts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substrings.dedup(documents(spark))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.split("Initial Plan")[0].count("ReusedExchange") == 1


def test_lengths_double():
    assert substrings.lengths(35) == [18, 35] and substrings.lengths(100) == [13, 25, 50, 100] and substrings.lengths(12) == [12]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ngram_join.link_groups(docs).count() == 0 and substrings.dedup(docs).count() == 0
