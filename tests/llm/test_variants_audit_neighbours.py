"""Spelling variants, filter interactions and nearest neighbours against plain Python."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from postern.llm import interactions, neighbours, spelling
from tests.llm.helpers import SCHEMA, SPACE, documents, lower, prose

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, least, noise):
    counts = collections.Counter()
    for d, t in rows:
        for w in RUNS.findall(lower(t)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    return counts


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(rows, least, least_count, factor, noise):
    n = {w: c for w, c in brute_counts(rows, least, noise).items() if c >= least_count}
    out = {}
    for w in n:
        near = [x for x in n if is_near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (n[w], len(near), best if best and n[best] >= factor * n[w] else None)
    rows = set()
    for w, (c, k, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.add((w, form, root, c, k, n[form] if form else None))
    return rows


def misspelt(seed, count):
    r = random.Random(seed)
    base = ["reading", "readings", "meeting", "Größe", "français", "international", "internationals", "ababab", "aaaaaa", "aaaaaaa", "xbaaaa"]
    out = []
    for _ in range(count):
        words = []
        for _ in range(30):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abéx") + w[i:], w[:i] + r.choice("abéx") + w[i + 1 :]])
            words.append(w.upper() if r.random() < 0.05 else w)
        out.append(r.choice([" ", "-", "\n1"]).join(words))
    return [*out, None, "", "×÷" * 4, "word " * 20_000, out[0], out[0]]


@pytest.mark.parametrize(("least", "least_count", "factor", "noise"), [(6, 5, 5, 199), (4, 1, 2, 3), (2, 1, 1, 7)])
def test_variants_match_brute_force(spark, least, least_count, factor, noise):
    docs = documents(spark, misspelt(1, 150 if least == 6 else 40))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # With factor 1 forms could go round in a circle, so roots are compared where counts must grow.
    want = brute_variants(rows, least, least_count, max(factor, 2), noise)
    got = {tuple(r) for r in spelling.variants(docs, least=least, least_count=least_count, factor=max(factor, 2), noise=noise).collect()}
    assert got == want and any(x[1] for x in want)
    assert least > 4 or any(x[1] and x[1] != x[2] for x in want)


def test_every_pair_within_one_edit_is_found(spark):
    """All words of up to five letters over two letters: every pair, each once, the longer or greater first."""
    words = ["".join(p) for n in range(2, 6) for p in itertools.product("ab", repeat=n)]
    found = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")).select("x", "y").collect()
    assert sorted(map(tuple, found)) == sorted((max(a, b, key=lambda w: (len(w), w)), min(a, b, key=lambda w: (len(w), w))) for a, b in itertools.combinations(words, 2) if is_near(a, b))


def test_a_task_that_forgets_words_loses_no_count(spark, monkeypatch):
    docs = documents(spark, misspelt(3, 20))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(spelling, "REMEMBERED", 2)
    assert {r.word: r.n for r in spelling.counted_words(docs).collect()} == brute_counts(rows, 6, 199)


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    texts = [(d, t or "", s or "") for d, t, s in rows]
    least = {}
    for d, t, _ in texts:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    facts = []
    for d, t, s in texts:
        w = SPACE.findall(t)
        fails = {k for k, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), d is not None and least[t] < d)) if x}
        facts.append((s, fails, d in good, d in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f[1:] for f in facts if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [x for x in own if f in x[0] and not x[0] & before]
                out[part, order, k + 1] = [
                    sum(not x[0] & (before | {f}) for x in own), len(here), sum(f in x[0] and bool(x[0] & before) for x in own), sum(x[0] == {f} for x in own),
                    sum(x[1] for x in here), sum(x[2] for x in here),
                ]
        for f in "ABCDE":
            mine = [key for key in out if key[0] == part and key[1][key[2] - 1] == f]
            total = sum(out[key][1] for key in mine)
            for key in mine:
                out[key].append(total)
    return {(*k, *v) for k, v in out.items()}


def audited(seed):
    r = random.Random(seed)
    texts = [prose(r.randint(1, 120), i) + r.choice(["", " # $", " ABC DEF GHI JKL" * 4, " one" * 40]) for i in range(60)]
    return [*texts, *texts[:12], *["copy of a line"] * 9, None, "", "  \n", "word " * 30_000]


def test_audit_matches_brute_force(spark):
    docs = documents(spark, audited(4)).selectExpr("*", "1 AS mask", "2 AS n", "'p' AS part")
    r = random.Random(5)
    labels = [(r.choice([None, *range(80)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    table = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, text string")
    got = {tuple(x) for x in interactions.audit(docs, table).collect()}
    assert got == brute_audit([(x.doc_id, x.text, x.source) for x in docs.collect()], labels)


def test_potentials_are_shapley_values_of_the_removal_game(spark):
    masks = spark.createDataFrame([("p", m, (m * 7919 + 5) % 13, 0, 0) for m in range(32)], "part string, mask int, n bigint, good bigint, toxic bigint")
    row = interactions.games(masks).first()
    n = {m: (m * 7919 + 5) % 13 for m in range(32)}
    for i in range(5):
        # Documents that fail k filters are shared among them in equal parts.
        share = sum(c * math.factorial(5) // bin(m).count("1") for m, c in n.items() if m >> i & 1)
        assert row.p[31] - row.p[31 - (1 << i)] == share


def dot(v, w):
    total = 0.0
    for x, y in zip(v, w):
        total += x * y
    return total


def brute_nearest(rows, k, every):
    ok = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = []
    for a, (q, v) in enumerate(ok):
        if q % every == 0:
            near = sorted((-dot(v, w), i) for b, (i, w) in enumerate(ok) if a != b and len(v) == len(w))[:k]
            out += [(q, j + 1, i, -s) for j, (s, i) in enumerate(near)]
    return sorted(out)


def vectors(spark, n, dim, seed, kind="array<float>"):
    g = np.random.default_rng(seed)
    v = (g.standard_normal((n, dim)) + g.standard_normal(dim) * 0.5).astype(np.float32).astype(float).tolist()
    rows = [(i, x) for i, x in enumerate(v)]
    rows += [(n + i, v[i % 3]) for i in range(70)] + [rows[0], rows[20], (None, v[0])]
    rows += [(10_000, None), (10_020, []), (10_040, [0.0] * dim), (10_060, [None] + v[0][1:]), (10_080, [float("nan")] + v[0][1:]), (10_100, [float("inf")] + v[0][1:])]
    rows += [(20_000 + i, [float(i + 1), 2.0]) for i in range(0, 60, 20)]
    return rows, spark.createDataFrame([(*r, 1, 0.5) for r in rows], f"vec_id bigint, embedding {kind}, row int, score double").repartition(3)


@pytest.mark.parametrize(("dim", "k", "kind"), [(16, 20, "array<float>"), (70, 5, "array<double>"), (1, 3, "array<float>")])
def test_nearest_matches_brute_force(spark, dim, k, kind):
    rows, table = vectors(spark, 300, dim, dim, kind)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(table, k=k).collect())
    assert got == brute_nearest(rows, k, 20)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows, table = vectors(spark, 200, 8, 3)
    for name, value in (("BLOCK_ROWS", 40), ("LEAST_ROWS", 16)):
        monkeypatch.setattr(neighbours, name, value)
    assert sorted(map(tuple, neighbours.nearest(table).collect())) == brute_nearest(rows, 20, 20)


def test_recall_of_the_registered_parameters():
    """Bounds at the registered width find at least 0.99 of the nearest among vectors without any structure."""
    g = np.random.default_rng(9)
    v = g.standard_normal((6_000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    turn, centre = neighbours.rotation(64), np.zeros(64)
    turned = v @ turn.T
    agree = np.abs(turned).sum(1) / 16
    block = {"vector": v, "first": np.arange(6_000), "code": np.packbits(turned > 0, axis=1), "scale": 1 / agree / 16, "error": np.sqrt(1 / agree**2 - 1) / np.sqrt(255), "offset": np.zeros(6_000)}
    found = neighbours.best_of_block(v[:100], block, centre, turn, 21)
    hits = sum(len(set(at.tolist()) & set(np.argsort(-(v @ v[i]))[:21].tolist())) for i, (at, _) in enumerate(found))
    assert hits >= 0.99 * 2100


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert spelling.variants(docs).count() == 0 and interactions.audit(docs, labels).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
