"""The corpus pipeline against a brute-force version in plain Python, and its stages one by one."""

from __future__ import annotations

import collections
import math

import pytest

import corpus_pipeline
from postern.llm import pieces, quality
from tests.llm.helpers import SPACE, prose
from tests.llm.test_copies import brute_components
from tests.llm.test_pii import spans
from tests.llm.test_texts import brute_hits

ITEM = prose(40, 77, "alpha beta gamma delta epsilon zeta eta theta iota kappa".split())


def fixture():
    english = "the of and to in a is that for it river stone light house walk tree wind paper voice glass".split()
    german = "der die und in den von zu das mit Fluss Stein Licht Haus Baum Wind Papier Stimme Glas".split()
    rows = [(i, prose(150 + i, 300 + i, english), "en") for i in range(25)] + [(100 + i, prose(150 + i, 400 + i, german), "de") for i in range(25)]
    rows += [(200 + i, f"{prose(60, 500 + i, english)} mail me a{i}@b.co or +1 (988) 555-24{i:02d} {prose(60, 600 + i, english)} 10.0.{i}.1", "en") for i in range(5)]
    rows += [(300, f"{prose(50, 700, english)} {ITEM[: len(ITEM) // 2]} {prose(50, 701, english)}", "en"), (301, None, "en"), (302, "", None), (303, "short text", "en")]
    rows += [(310 + i, " ".join(w + "###$$$" for w in prose(200, 710 + i, english).split()), "en") for i in range(3)] + [(320, "again and again the same eight words here " * 30, "en")]
    base = prose(150, 810, english).split(" ")
    rows += [(330 + i, " ".join([*base[: 10 * i], *["changed"] * (i % 4), *base[10 * i :]]), "en") for i in range(12)]
    rows += [(5, rows[5][1], "en"), (rows[60][0] + 1000, rows[60][1], None), (None, prose(150, 900, english), "en")]
    # Rows without a doc_id: one is hit, another has a copy.
    rows += [(None, f"{prose(70, 901, english)} {ITEM} {prose(70, 902, english)}", "en"), (None, prose(150, 903, english), "en"), (None, prose(150, 903, english), "en")]
    return [(d, t, x, "s", None if t is None else len(t)) for d, t, x in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(fixture(), "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def histograms(text):
    classes, common = collections.Counter(), collections.Counter()
    for ch in text:
        name = next((n for n, yes in (("lower", "a" <= ch <= "z"), ("upper", "A" <= ch <= "Z"), ("digit", "0" <= ch <= "9"), ("space", ch in " \t"), ("line", ch in "\n\r\v\f"), ("other", ord(ch) >= 128)) if yes), None)
        classes[name or ("control" if ord(ch) < 32 or ord(ch) == 127 else "mark" if ch in ".,;:!?'\"()-" else "symbol")] += 1
    for w in SPACE.findall(text):
        plain = w[:-1] if w not in quality.WORDS and w[-1] in ".,;:!?" else w
        low = plain[:1].lower() + plain[1:]
        known = next((x for x in (plain, low) if x in quality.WORDS), None)
        common[known] += 1
    return classes, common


def jensen_shannon(a, b):
    m, n = sum(a.values()), sum(b.values())
    if not m:
        return 0.0
    total = 0.0
    for k in {*a, *b}:
        p, q = a[k] / m, b[k] / n
        mid = (p + q) / 2
        total += (p * math.log2(p / mid) if p else 0) + (q * math.log2(q / mid) if q else 0)
    return math.sqrt(max(0.0, total / 2))


def brute(rows):
    refs = {}
    for _, t, lang, *_ in rows:
        if t is not None and lang in quality.COMMON:
            own = refs.setdefault(lang, (collections.Counter(), collections.Counter()))
            for total, part in zip(own, histograms(t)):
                total.update(part)
    good = []
    for row in rows:
        w = SPACE.findall(row[1] or "")
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        if len(w) < 20 or 100 * len(again) > 30 * len(w):
            continue
        own = histograms(row[1])
        allowed = [a + b / math.sqrt(max(1, sum(h.values()))) for a, b, h in zip(quality.ALLOWED, quality.WIDEN, own)]
        near = min(([jensen_shannon(h, r) for h, r in zip(own, ref)] for ref in refs.values()), key=lambda d: max(x / a for x, a in zip(d, allowed)))
        if not any(sum(h.values()) >= least and d > a for h, least, d, a in zip(own, quality.LEAST, near, allowed)):
            good.append(row)
    root = brute_components([(d, t) for d, t, *_ in good if d is not None], 5, 80)
    seen, first = set(), []
    for row in sorted(good, key=lambda r: (r[0] is not None, r[0])):
        if row[0] is None or (root[row[0]][1] == row[0] and row[0] not in seen):
            seen.add(row[0])
            first.append(row)
    clean = [r for r in first if not brute_hits(r[1], [(1, ITEM)])[4]]
    lib, out = pieces.pieces(pieces.default_model()).lib, []
    for d, t, *_ in clean:
        at, text = 0, ""
        for kind, a, b in sorted(spans(t), key=lambda s: s[1]):
            text, at = text + t[at:a] + f"[{kind.upper()}]", b
        ids = lib.encode(text + t[at:])
        out.append((d, len(ids), ids))
    return sorted(out, key=str)


def test_run_matches_brute_force(spark, sf):
    want = brute(fixture())
    got = sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()), key=str)
    assert got == want
    ids = {d for d, *_ in want}
    assert None in ids and not ids & {300, 301, 302, 303, 310, 311, 312, 320} and {0, 100, 200, 330} <= ids and len(ids & set(range(330, 342))) < 12


def test_texts_of_a_repeated_doc_id_stay(spark, sf):
    a, b = prose(80, 1), prose(80, 2)
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (7, b, "x"), (1, a, "x")], "doc_id bigint, text string, lang string").repartition(3)
    assert sorted(tuple(r)[:2] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()) == sorted([(1, a), (1, b)])


def test_a_hit_without_doc_id_takes_no_other_row_along(spark, sf):
    docs = spark.createDataFrame([(None, f"a {ITEM} b", 1), (None, "clean words", 2), (None, None, 3), (4, f"a {ITEM} b", 4), (4, "clean too", 5)], "doc_id bigint, text string, _row int")
    kept = corpus_pipeline.benchmark_free(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r._row for r in kept.collect()) == [2, 3, 5]


def test_of_rows_equal_in_id_and_text_the_least_stays(spark, sf):
    t = prose(80, 1)
    docs = spark.createDataFrame([(1, t, "b", "z"), (1, t, "a", "y"), (1, t, None, "y")], "doc_id bigint, text string, lang string, rest string").repartition(3)
    assert [(r.lang, r.rest) for r in corpus_pipeline.near_copies(spark, docs, sf).collect()] == [(None, "y")]


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "personal_data", "sentencepiece"]
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, sf).columns == docs.columns


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
