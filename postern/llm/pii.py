r"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

High-recall generators propose spans, which may overlap: four base kinds with fixed patterns, and further kinds
(keys with a value, upper-case codes, hex strings, numbers like 123-45-6789, telephone numbers without country code).
Each candidate has features of its format (length, digits, letters, marks, distinct characters) and its context (the
characters around it). Boosted trees score it. Base kinds that pass their check always count;
proposed candidates count above their kind's threshold, the lowest at which the held-out candidates, a fifth of all,
reached `PRECISION`. A kind with fewer than `LEAST_HELD` held-out candidates, or where no threshold reaches that, is
judged by its label rule instead, so no kind is dropped for being rare. Spans may
overlap; none is dropped for that, and `redacted` merges them.

Labels for training are not given, so they come from rules (cue words before it, valid area and exchange codes, known
prefixes): `seed` below. None of these is a feature; only the rule of `key`, length and a digit, can be seen in them. The trees are fitted on at most about `SAMPLE` candidates of each
proposed kind, chosen by hash; thresholds come from one aggregation over all candidates. The fitted trees become one SQL expression, so scoring is part of the row's projection: no shuffle,
no Python. Offsets come from the pieces between matches, summed in blocks, so many matches in a text stay cheap.

Defined cases: a null or empty text has no spans; without candidates of two labels to learn from, each
proposed kind is judged by its label rule; rows repeating a doc_id are each searched; texts are searched whole; `redact` keeps a null text null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.session import stage

# Base patterns. Possessive where nothing could be given back; \G lets a match begin where the last ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "code": r"(?<![A-Za-z0-9])(?=[A-Z0-9]{12})(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]++(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{16,}+(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]\x20?\"?[^\s\"]{4,}+\"?",
    "local": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = [*BASE, *PROPOSED]
CUE = r"(?i)(?:mail|tel|phone|call|fax|card|ssn|social|password|passwd|pwd|secret|token|key|account|iban)[^A-Za-z0-9]{0,4}$"

#: A cue of a secret anywhere in the 24 characters before a hex string.
NEAR = r"(?i)(?:password|passwd|pwd|secret|token|key|auth|credential|bearer)"

#: Candidates of each proposed kind to fit on.
SAMPLE, TREES, DEPTH, PRECISION = 20_000, 20, 3, 0.9
#: Held-out candidates a kind's threshold needs.
LEAST_HELD = 20
_BUCKETS = 1_000_000_000
_BLOCK = 256

FEATURES = ["len", "digits", "upper", "lower", "marks", "distinct", "tight", "glued", *[f"is_{k}" for k in KINDS]]


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _guard(kind: str) -> str:
    return {"email": "contains(text, '@')", "phone": "contains(text, '+') AND has_digit", "key": "contains(text, '=') OR contains(text, ':')", "ip": "contains(text, '.') AND has_digit"}.get(kind, "has_digit")


def _offsets(kind: str) -> str:
    """Structs of start, end, value and the pieces around each match, from running sums of lengths in blocks."""
    item = f"zip_with(m_{kind}, p_{kind}, (m, p) -> named_struct('m', m, 'g', length(p), 'p', right(p, 24)))"
    items = f"slice(zip_with({item}, slice(p_{kind}, 2, size(p_{kind})), (x, p) -> named_struct('m', x.m, 'g', x.g, 'p', x.p, 'n', left(p, 4))), 1, size(m_{kind}))"
    blocks = f"transform(sequence(0, (size(m_{kind}) - 1) div {_BLOCK}), b -> slice(items, b * {_BLOCK} + 1, {_BLOCK}))"
    none = "cast(array() AS array<int>)"
    bases = f"aggregate(blocks, named_struct('at', 0, 'acc', {none}), (s, b) -> named_struct('at', s.at + aggregate(b, 0, (t, x) -> t + x.g + length(x.m)), 'acc', concat(s.acc, array(s.at))), s -> s.acc)"
    row = "named_struct('start', s.at + x.g, 'end', s.at + x.g + length(x.m), 'value', x.m, 'before', x.p, 'after', x.n)"
    empty = "cast(array() AS array<struct<start:int,end:int,value:string,before:string,after:string>>)"
    inner = f"aggregate(b, named_struct('at', base, 'acc', {empty}), (s, x) -> named_struct('at', s.at + x.g + length(x.m), 'acc', concat(s.acc, array({row}))), s -> s.acc)"
    # Each name is bound once by a transform over a one-element array.
    bound = f"flatten(transform(array({items}), items -> flatten(transform(array({blocks}), blocks -> flatten(zip_with(blocks, {bases}, (b, base) -> {inner}))))))"
    return f"CASE WHEN size(m_{kind}) > 0 THEN {bound} ELSE {empty} END"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


_CHECK = {
    "email": "true",
    "ip": r"forall(split(c.value, '[.]'), q -> q rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
    "card": f"length({_digits('c.value')}) BETWEEN 13 AND 19 AND luhn_check({_digits('c.value')})",
    "phone": f"length({_digits('c.value')}) BETWEEN 9 AND 15",
}
_SEED = {
    "code": "c.value rlike '^(AKIA|ASIA|AIza|GOCSPX)' OR c.before rlike {cue}",
    "hex": "c.before rlike {near}",
    "key": "length(c.value) >= 14 AND c.value rlike '[0-9]'",
    "local": "c.before rlike {cue} OR startswith(c.value, '(') OR " + _digits("c.value") + " rlike '^[2-9](?!11)[0-8][0-9][2-9](?!11)[0-9]{6}$'",
    "number": "NOT c.value rlike '^(000|666|9)' AND NOT c.value rlike '-00-|-0000$'",
}


def _candidate(kind: str) -> str:
    count = lambda chars: f"length(c.value) - length(regexp_replace(c.value, '[{chars}]', ''))"
    seed = _SEED.get(kind, _CHECK.get(kind, "false")).replace("{cue}", _sql(CUE)).replace("{near}", _sql(NEAR))
    flags = ", ".join(f"'is_{k}', {int(k == kind)}" for k in KINDS)
    return (
        f"transform(o_{kind}, c -> named_struct('kind', '{kind}', 'rank', {KINDS.index(kind)}, 'start', c.start, 'end', c.end, 'base', {_CHECK.get(kind, 'false')}, 'seed', {seed}, "
        f"'len', length(c.value), 'digits', {count('0-9')}, 'upper', {count('A-Z')}, 'lower', {count('a-z')}, 'marks', {count('^A-Za-z0-9')}, "
        f"'distinct', size(array_distinct(split(c.value, ''))), 'tight', int(c.before rlike '[=:(\"]$'), 'glued', int(c.after rlike '^[A-Za-z0-9]'), {flags}))"
    )


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the column `_found`: the candidates of each text, by kind, then start."""
    names = [f"_d{i}" for i in range(len(docs.columns))]
    df = docs.toDF(*names).withColumn("text", F.coalesce(F.col(names[docs.columns.index(text)]), F.lit("")))
    df = df.withColumn("has_digit", F.expr("text rlike '[0-9]'"))
    for step in (
        {f"m_{k}": F.expr(f"CASE WHEN {_guard(k)} THEN regexp_extract_all(text, {_sql(p)}, 0) ELSE array() END") for k, p in {**BASE, **PROPOSED}.items()},
        {f"p_{k}": F.expr(f"CASE WHEN size(m_{k}) > 0 THEN split(text, {_sql(p)}, -1) ELSE array('') END") for k, p in {**BASE, **PROPOSED}.items()},
        {f"o_{k}": F.expr(_offsets(k)) for k in KINDS},
        {"_found": F.expr(f"concat({', '.join(_candidate(k) for k in KINDS)})")},
    ):
        df = df.withColumns(step)
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], "_found")


@dataclass
class Model:
    """Score as one SQL expression over a candidate `c` (the trees, or a kind's label rule), and each kind's threshold."""

    score: str
    thresholds: dict[str, float]


def _tree(node) -> str:
    if node.getClass().getSimpleName() == "LeafNode":
        return repr(float(node.prediction()))
    split = node.split()
    return f"CASE WHEN c.{FEATURES[split.featureIndex()]} <= {float(split.threshold())!r} THEN {_tree(node.leftChild())} ELSE {_tree(node.rightChild())} END"


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> Model:
    """Fit on about `sample` candidates of each proposed kind, chosen by hash; a fifth of all is held out for thresholds."""
    found = with_candidates(docs.select(doc_id, text), text).select(F.xxhash64(doc_id).alias("h"), F.explode(F.expr(f"filter(_found, c -> c.rank >= {len(BASE)})")).alias("c"))
    rows = stage(found.select(F.abs(F.xxhash64("h", "c.rank", "c.start") % _BUCKETS).alias("h"), "c.kind", F.col("c.seed").cast("int").alias("label"), *[F.col(f"c.{f}").cast("double").alias(f) for f in FEATURES]))
    below = {r["kind"]: max(1, int(min(1.0, sample / r["count"]) * _BUCKETS)) for r in rows.groupBy("kind").count().collect()}
    ruled, thresholds, margin = set(PROPOSED), dict.fromkeys(PROPOSED, 0.5), "0.0D"
    limit = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in below.items()) + " END" if below else "0"
    fit = rows.where(f"h < {limit} AND h % 5 <> 0")
    if fit.agg(F.count_distinct("label")).first()[0] == 2:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, cacheNodeIds=False).fit(vectors.transform(fit))
        margin = " + ".join(f"{float(w)!r}D * ({_tree(t._call_java('rootNode'))})" for w, t in zip(model.treeWeights, model.trees))
        scored = rows.where("h % 5 = 0").select("kind", "label", F.struct(*FEATURES).alias("c")).select("kind", "label", F.expr(f"round({_score(margin)}, 2)").alias("p"))
        steps = scored.groupBy("kind", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).orderBy("kind", F.desc("p")).collect()
        for kind in PROPOSED:
            low = _threshold([(r["p"], r["n"], r["good"]) for r in steps if r["kind"] == kind], precision)
            if low is not None:
                thresholds[kind] = low
                ruled.discard(kind)
    by_rule = " OR ".join(f"c.kind = '{k}'" for k in sorted(ruled)) or "false"
    return Model(f"CASE WHEN {by_rule} THEN cast(cast(c.seed AS int) AS double) ELSE {_score(margin)} END", thresholds)


def _score(margin: str) -> str:
    return f"1 / (1 + exp(-2 * ({margin})))"


def _threshold(steps: list[tuple[float, int, int]], precision: float) -> float | None:
    """Lowest score of 0.5 or more down to which `precision` holds; None with too few rows, or if there is none."""
    n = good = 0
    low = None
    for p, rows, right in steps:
        n, good = n + rows, good + right
        if good >= precision * n and p >= 0.5:
            low = p
    return low if n >= LEAST_HELD else None


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with the column `spans`: (kind, rank, start, end, base, score) by kind, then start."""
    low = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {max(0.0, t - 0.005)}D" for k, t in model.thresholds.items()) + " ELSE 2.0D END" if model.thresholds else "2.0D"
    short = f"transform(_found, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'rank', c.rank, 'base', c.base, 'score', CASE WHEN c.base THEN 1.0D ELSE {model.score} END, 'low', {low}))"
    kept = f"filter({short}, c -> c.base OR (c.rank >= {len(BASE)} AND c.score >= c.low))"
    ordered = f"array_sort(transform({kept}, c -> named_struct('rank', c.rank, 'start', c.start, 'end', c.end, 'kind', c.kind, 'base', c.base, 'score', c.score)))"
    return with_candidates(docs, text).withColumn("spans", F.expr(ordered)).drop("_found")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    join = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.base AND s.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")
    base = join("filter(spans, s -> s.base)")
    return found.select(doc_id, *[count(k) for k in BASE], F.expr(f"sha2(cast({base} AS binary), 256)").alias("base_sha256"), F.expr(join("spans")).alias("spans"))


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with each run of overlapping spans replaced by `[KIND]` of its first span."""
    merged = (
        f"aggregate(array_sort(transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))), "
        "cast(array() AS array<struct<start:int,end:int,kind:string>>), "
        "(a, s) -> CASE WHEN size(a) > 0 AND s.start < element_at(a, -1).end THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind))) ELSE concat(a, array(s)) END)"
    )
    part = f"concat(substring({text}, CASE WHEN i = 0 THEN 1 ELSE m[i - 1].end + 1 END, s.start - CASE WHEN i = 0 THEN 0 ELSE m[i - 1].end END), '[', upper(s.kind), ']')"
    whole = f"concat(array_join(transform(m, (s, i) -> {part}), ''), substring({text}, element_at(m, -1).end + 1))"
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN transform(array({merged}), m -> {whole})[0] ELSE {text} END")
