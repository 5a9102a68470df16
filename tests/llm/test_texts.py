"""License scans, quality rules, language identification and decontamination against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postern.llm import decontaminate, language, licences, quality
from tests.llm.helpers import ALNUM, SCHEMA, SPACE, documents, lower, odd_texts, ordered, prose


def phrase_places(text):
    w = ALNUM.findall(lower(text))
    found = []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return w, found


LICENCES = [
    "MIT License", "the mit MIT license license apache license", "general general public license general public license GENERAL-PUBLIC\nLICENSE", "mit license",
    "x Licensed under the Apache License, Version 2.0. y", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files z",
    "All rights reserved.", "license", prose(5000, 8) + " mit license " + prose(10, 9),
]


def test_license_phrases_and_templates(spark):
    docs = documents(spark, [*odd_texts(), *LICENCES])
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = licences.digest(licences.scan(docs)).collect()
    assert len(out) == docs.count()
    for r in out:
        w, found = phrase_places(texts[r.doc_id])
        starts = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {texts[r.doc_id]: r.labels for r in out}
    assert labels[LICENCES[4]] == "apache" and labels[LICENCES[5]] == "mit" and labels[LICENCES[6]] == "proprietary" and labels[LICENCES[7]] == ""


def test_license_phrases_and_templates_of_one_word(spark):
    docs = documents(spark, ["copyleft", "a COPYLEFT copyleft b", "x wtfpl", "none of them", "mit license", "wtfpl copyleft mit license", None, ""])
    out = licences.digest(licences.scan(docs, templates=[("wtf", "WTFPL"), ("empty", "")], phrases={"copyleft": "free", "mit license": "mit"}))
    got = {(r.doc_id, r.n_base, r.first_word, r.last_word, r.labels) for r in out.collect() if r.doc_id is not None}
    assert got == {
        (0, 1, 0, 0, "free"), (1, 2, 1, 2, "free"), (2, 0, None, None, "wtf"), (3, 0, None, None, ""), (4, 1, 0, 0, "mit"), (5, 2, 1, 2, "free,mit,wtf"), (6, 0, None, None, ""), (7, 0, None, None, ""),
    }


def brute_chain(codes, template, least, gap):
    """Most words of the template that one chain of maximal matches covers, over all chains."""
    matches = []
    for i in range(len(codes)):
        for j in range(len(template)):
            n = 0
            while i + n < len(codes) and j + n < len(template) and codes[i + n] == template[j + n]:
                n += 1
            if n >= least and (i == 0 or not any(codes[i - 1 : i + n] == template[x : x + n + 1] for x in range(len(template)))):
                if i + n == len(codes) or not any(codes[i : i + n + 1] == template[x : x + n + 1] for x in range(len(template))):
                    matches.append((i, n, j))
    best = []
    for i, n, j in matches:
        own = [n]
        for (p, m, q), covered in zip(matches, best):
            skip = max(0, q + m - j, p + m - i)
            if skip < n and i + skip - (p + m) <= gap:
                own.append(covered + n - skip)
        best.append(max(own))
    return max(best, default=0)


def test_license_chain_reaches_over_many_open_chains():
    """Many chains are open at once, more than eight of which can't be continued; none is forgotten or spoiled."""
    words = [f"w{i}" for i in range(40)]
    s = licences.Scanner([("a", " ".join(words))], {}, 1, 60, 0.9)
    ids = [s.ids[w.encode()] for w in words]
    noise = [x for i in range(10) for x in (-1, ids[39 - i])]
    spans = s.spans(np.array([*ids[:20], *noise, -1, *ids[20:]]))
    assert [(x["start"], x["end"], x["covered"]) for x in spans] == [(0, 61, 1.0)]


def test_license_chains_cover_as_much_as_any_chain():
    r = random.Random(11)
    for _ in range(300):
        size, least, gap = r.randint(4, 14), r.randint(1, 3), r.randint(0, 6)
        template = [f"t{r.randint(0, 5)}" for _ in range(size)]
        s = licences.Scanner([("a", " ".join(template))], {}, least, gap, 0.01)
        own = [s.ids[w.encode()] for w in template]
        codes = []
        for _ in range(r.randint(1, 6)):
            i = r.randint(0, size - 1)
            codes += own[i : i + r.randint(1, 6)] + [-1] * r.randint(0, 3)
        got = max((x["covered"] for x in s.spans(np.array(codes))), default=0)
        assert got == min(1.0, brute_chain(codes, own, least, gap) / size)


def test_matching_statistics_are_longest_common_runs():
    """Each maximal match of the automaton is the longest run that ends there and occurs in a template."""
    templates = [("a", "one two three two three four"), ("b", "three two one two")]
    s = licences.Scanner(templates, {}, 2, 3, 0.5)
    ids = [s.ids[w.encode()] for w in "two three two one two three four four one two".split()]
    known = {tuple(seq[i:j]) for seq in ([s.ids[w.encode()] for w in t.split()] for _, t in templates) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)}
    ends = {}
    for start, n, state in s.automaton.matches(ids, 0):
        run = tuple(ids[start : start + n])
        assert run in known and (start + n == len(ids) or (*run, ids[start + n]) not in known)
        assert start == 0 or tuple(ids[start - 1 : start + n]) not in known
        assert s.automaton.places[state]
        ends[start + n] = n
    assert max(ends) == len(ids)


def test_quality_counts(spark):
    docs = documents(spark, [*odd_texts(), "w" + " $$ ## of the" * 30, prose(300, 11), " | ".join(prose(1, i) for i in range(400))])
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = quality.judge(docs, ["doc_id"]).collect()
    assert len(out) == docs.count()
    for r in out:
        t = texts[r.doc_id] or ""
        w = SPACE.findall(t)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_quality_divergence_keeps_prose_and_drops_junk(spark, sf="/root/testdata/sf0.01"):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    refs = quality.references(docs)
    assert set(refs) == {"de", "en", "es", "fr"}
    rows = quality.judge(docs, ["doc_id"], refs=refs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.35
    whole = quality.filtered(docs, refs=refs)
    assert whole.columns == docs.columns and whole.count() == quality.judge(docs, ["doc_id"], refs=refs).where("kept").count()


CYRILLIC = "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой река камень свет дом утро дерево ветер бумага голос стекло зима лето".split()
POLISH = "i w nie na z się do to że jest o jak ale po co tak za od go rzeka kamień światło dom poranek drzewo wiatr papier głos szkło zima lato".split()


@pytest.mark.parametrize("others", [["en"], []])
def test_quality_keeps_prose_of_languages_without_given_words(spark, others):
    rows = [(i, prose(300, i), x) for x in others for i in range(20)]
    rows += [(100 + i, prose(300, 100 + i, CYRILLIC), "ru") for i in range(20)] + [(200 + i, prose(300, 200 + i, POLISH), "pl") for i in range(20)]
    rows += [(300, prose(300, 300, CYRILLIC), "bg"), (301, prose(300, 301, POLISH), None)]
    junk = [(400 + i, " ".join(w + "###$$$" for w in prose(200, 400 + i, POLISH).split()), x) for i, x in enumerate(["ru", "pl", *others])]
    docs = spark.createDataFrame(rows + junk, "doc_id bigint, text string, lang string").repartition(3)
    refs = quality.references(docs)
    assert set(refs) == {"ru", "pl", *others}
    out = {r.doc_id: r for r in quality.judge(docs, ["doc_id"]).collect()}
    assert all(out[d].kept for d, *_ in rows) and not any(out[d].kept for d, *_ in junk)
    assert {out[d].nearest for d, _, x in rows if x == "ru"} == {"ru"} and {out[d].nearest for d, _, x in rows if x == "pl"} == {"pl"}
    assert sorted(r.doc_id for r in quality.filtered(docs).collect()) == sorted(d for d, *_ in rows)


def test_quality_distances_are_jensen_shannon():
    r = np.random.default_rng(3)
    own = r.integers(0, 5, (40, 30)) * (r.random((40, 30)) < 0.3)
    own[7] = 0
    refs = [r.integers(0, 9, 30).astype(float), r.integers(0, 2, 30).astype(float), np.zeros(30)]
    for i, reference in enumerate(refs):
        for row, got in zip(own, quality.distances(own, refs)[i]):
            p, q = row / max(1, row.sum()), reference / max(1, reference.sum())
            js = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2
            assert got == pytest.approx(math.sqrt(js) if row.sum() else 0.0, abs=1e-9)


def test_quality_bounds_the_languages_it_learns(spark, monkeypatch):
    """A language column full of dirt: the most frequent languages are learned, the rest judged by the hard rules."""
    monkeypatch.setattr(quality, "LEAST_LEARNED", (100, 20))
    rows = [(i, prose(60, i, [f"{x}w{j}" for j in range(30)]), x) for i, x in enumerate([f"x{k % 300}" for k in range(600)] + ["ru", "pl"] * 30)]
    docs = spark.createDataFrame([(i, prose(300, i, CYRILLIC if x == "ru" else POLISH) if x in ("ru", "pl") else t, x) for i, t, x in rows], "doc_id bigint, text string, lang string").repartition(3)
    refs = quality.references(docs)
    assert len(refs) == quality.LANGUAGES and {"ru", "pl"} <= set(refs) and len(refs.words) <= len(quality.WORDS) + quality.LANGUAGES * quality.LEARNED
    out = quality.judge(docs, ["doc_id"], refs=refs)
    assert out.count() == len(rows) and out.where("not base_failed and not kept").join(docs.where(~F.col("lang").isin(list(refs))), "doc_id").count() == 0


def test_language_held_out_accuracy(spark, sf="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out)


def brute_features(text, buckets):
    """The hashed n-grams in plain Python integers."""
    text, out, top = f" {text.lower()} ", collections.Counter(), (1 << 64) - 1
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            h = n
            for ch in text[i : i + n]:
                h = ((h ^ ord(ch)) * 0x9E3779B97F4A7C15) & top
                h ^= h >> 29
            out[h % buckets] += 1
    return out


def test_language_counts_weights_and_scores_match_brute_force(spark):
    french = "le fleuve et la pierre de lumière maison été où garçon".split()
    texts = [(i, prose(12 + i, i), "en") for i in range(9)] + [(20 + i, prose(10 + i, i, french), "fr") for i in range(9)] + [(40 + i, prose(9, i, CYRILLIC), "ru") for i in range(5)]
    texts += [(60, None, "en"), (61, "", "fr"), (62, "Straße 漢字 x", None), (63, "x" * 700, "en"), (64, prose(3000, 5, french), None), (65, "123 --", "ru"), (1, prose(13, 1), "en"), (None, "la maison", "fr")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string").repartition(3)
    size, alpha = language.BUCKETS, language.ALPHA
    out_of_training = {i for i, *_ in texts if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    count, n_docs = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t, x in texts:
        if i not in out_of_training and t is not None and x is not None:
            n_docs[x] += 1
            count[x] += brute_features(t, size)
    got = collections.defaultdict(dict)
    for r in language.counts(docs.where(~language.held_out())).collect():
        got[r.lang][r.bucket] = r.n
    assert {x: {-1: n_docs[x], **count[x]} for x in n_docs} == dict(got)
    names, total = sorted(n_docs), sum(n_docs.values())
    log = {x: collections.defaultdict(lambda low=math.log(alpha) - math.log(sum(count[x].values()) + alpha * size): low) for x in names}
    for x in names:
        log[x].update({b: math.log(n + alpha) - math.log(sum(count[x].values()) + alpha * size) for b, n in count[x].items()})
    want = []
    for i, t, _ in texts:
        if not any(c.isalpha() for c in t or ""):
            want.append((i, i in out_of_training, "und", 0.0))
            continue
        own = brute_features(t, size)
        sums = [math.log(n_docs[x] / total) + math.fsum(n * log[x][b] for b, n in own.items()) for x in names]
        best = max(range(len(names)), key=sums.__getitem__)
        want.append((i, i in out_of_training, names[best], 1 / math.fsum(math.exp(v - sums[best]) for v in sums)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    found = sorted((tuple(r) for r in language.identify(docs).collect()), key=key)
    for a, b in zip(found, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)


def test_language_odd_cases(spark):
    docs = documents(spark, [*odd_texts(), "123 456 !!"])
    out = language.identify(docs).collect()
    assert len(out) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def brute_hits(text, items, window=10):
    w = ALNUM.findall(lower(text))
    hit, names = set(), set()
    for name, item in items:
        b = ALNUM.findall(lower(item))
        n = min(window, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, prose(30, 20)), (2, None), (3, ""), (10, "only two"), (11, "single"), (12, prose(30, 20)), (None, "four words in here"), (1, prose(30, 20)), (13, "same same same same same same same same same same same same")]


def test_decontamination_matches_brute_force(spark):
    item = prose(30, 20)
    extra = [item, prose(15, 21) + " " + item[: len(item) * 2 // 3] + " " + prose(5, 22), "has ONLY two, words; single", "same " * 25, (item + " ") * 3, "four words in here"]
    docs = documents(spark, [*odd_texts(), *extra])
    items = spark.createDataFrame([(i, t, "c") for i, t in ITEMS], "item_id bigint, text string, doc_id string")
    out = decontaminate.digest(decontaminate.decontaminate(docs, items))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    named = [(i, t) for i, t in ITEMS if i is not None]
    want = []
    for d, t in texts:
        n, _, n_items, digest, _ = brute_hits(t, named)
        _, hit, _, _, bad = brute_hits(t, ITEMS)
        want.append((d, n, hit, n_items, digest, bad))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)


def test_a_whole_long_document_may_be_a_hit(spark):
    """One run of 100,000 words: its rows are narrow, so they take about as much as the text."""
    text = " ".join(f"w{i % 9973}x{i % 89}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "x " + " ".join(text.split()[:300]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, text)], "item_id bigint, text string")
    out = {r.doc_id: r for r in decontaminate.digest(decontaminate.decontaminate(docs, items)).collect()}
    assert (out[1].n_hit, out[1].n_items) == (100_000, 1) and out[2].n_hit == 300


@pytest.mark.parametrize("which", ["docs", "items"])
def test_decontamination_of_empty_tables(spark, which):
    docs = documents(spark, [] if which == "docs" else None)
    items = spark.createDataFrame(ITEMS if which == "docs" else [], "item_id bigint, text string")
    out = decontaminate.digest(decontaminate.decontaminate(docs, items)).collect()
    assert len(out) == docs.count() and not any(r.contaminated for r in out)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert licences.scan(docs).count() == quality.judge(docs, ["doc_id"]).count() == language.identify(docs).count() == 0
    assert ordered(quality.filtered(docs), "doc_id") == []
