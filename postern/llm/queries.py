"""Registered queries of this package, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postern.llm import chat, decontaminate, interactions, language, licences, neighbours, ngram_join, pieces, pii, quality, spelling, substrings, token_files
from postern.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_TRICKY = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(_table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_groups(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _TRICKY), (-1, 1, "assistant", _TRICKY)], turns.schema)
    return chat.read_back(stage(chat.segments(turns.unionByName(extra))))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode(_table(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup(_table(spark, sf_dir, "documents")))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.train(docs)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


# Words of the digests: A-Z in lower case, then runs outside these ASCII ranges; or runs outside white space.
_ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op10_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
place AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, p.n, item_id FROM place p JOIN win USING (n, s)),
covered AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER_SPACE_WORDS = _SPACE_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

ORACLES["op3_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_SPACE_WORDS} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id
FROM documents LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)"""

ORACLES["op7_substring_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPACE_WORDS} AS w FROM documents),
win AS (
  SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN again USING (s)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

_CONTROLS = chat.INST.controls
_ESCAPED = "replace(text, '\\', '\\\\')"
for _c in _CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\-{_c[1:]}')"

_AROUND = " ".join(f"WHEN '{r}' THEN {len(t.before + t.after)}" for r, t in chat.INST.turns.items())

ORACLES["op5_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{_TRICKY}'),
s AS (
  SELECT *, {_ESCAPED} AS e, lag(role) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(e) + CASE role {_AROUND} ELSE 23 + length(role) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL OR before = 'assistant' THEN role = 'user' OR (before IS NULL AND role = 'system')
    WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant' ELSE false END AND (NOT final OR role = 'assistant')) AS valid
FROM s GROUP BY conv_id"""

# Checksum of a string of code points below 256: its UTF-8 bytes fold into the reversed polynomial 3988292384.
_BYTES = "flatten(list_transform(string_split(z, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"

ORACLES["op11_spelling_variants"] = f"""
WITH RECURSIVE t AS (SELECT {_TABLE} AS crc),
o AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w
    FROM documents) GROUP BY doc_id, w),
h AS (
  SELECT w, n, xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS z FROM o WHERE length(w) >= 6), t),
c AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS s FROM (SELECT *, unnest(range(0, length(word))) AS i FROM c)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT g.word, c.word, c.n FROM g JOIN c ON g.s = c.word
  UNION SELECT c.word, g.word, g.n FROM g JOIN c ON g.s = c.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM c LEFT JOIN best USING (word)),
path AS (SELECT word, word AS tip, 0 AS k FROM f UNION ALL SELECT path.word, f.form, k + 1 FROM path JOIN f ON f.word = path.tip WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(tip, k) AS root FROM path GROUP BY word) USING (word)"""

ORACLES["op12_filter_audit"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, {_SPACE_WORDS} AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT r, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || p.c || q.c || s.c AS filter_order FROM c a, c b, c p, c q, c s
  WHERE a.c NOT IN (b.c, p.c, q.c, s.c) AND b.c NOT IN (p.c, q.c, s.c) AND p.c NOT IN (q.c, s.c) AND q.c <> s.c),
k AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY part, fails),
s AS (
  SELECT part, filter_order, step, f,
    n * CAST(translate(fails, filter_order[1 : step], '') = fails AS INT) AS kept,
    n * CAST(hit AND first AS INT) AS removed, good * CAST(hit AND first AS INT) AS good_lost, toxic * CAST(hit AND first AS INT) AS toxic_lost,
    n * CAST(hit AND NOT first AS INT) AS redundant, n * CAST(fails = f AS INT) AS unique_fails
  FROM (
    SELECT *, contains(fails, f) AS hit, translate(fails, filter_order[1 : step - 1], '') = fails AS first
    FROM (SELECT *, filter_order[step] AS f FROM k, o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)))),
g AS (
  SELECT part, filter_order, step, any_value(f) AS f, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(redundant) AS BIGINT) AS redundant,
    CAST(sum(unique_fails) AS BIGINT) AS unique_fails, CAST(sum(good_lost) AS BIGINT) AS good_lost, CAST(sum(toxic_lost) AS BIGINT) AS toxic_lost
  FROM s GROUP BY part, filter_order, step)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""
ORACLES["op13_nearest_neighbours"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, v.vec_id, list_dot_product(q.e, v.e) AS score FROM v q JOIN v ON q.r <> v.r AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

QUERIES |= {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_ngram_join, op4_token_files, op5_chat_format, op6_sentencepiece, op7_substring_dedup, op8_personal_data, op9_language_id, op10_decontamination, op11_spelling_variants, op12_filter_audit, op13_nearest_neighbours)}
