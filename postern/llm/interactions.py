"""Filter interaction audit: what each filter removes, alone, in every order and on average.

Each document is reduced to the set of filters it fails (a bit mask), and each part (source) to a count of documents a
mask, at most 32 rows. All results follow from the removal game of a part: v(S) is the number of documents that the
filters of coalition S remove together.

* Steps. A filter f that comes after the set S removes v(S + f) - v(S); what it finds removed already is v(f) minus that;
  what it alone fails is v(all) - v(all without f). Labels are further games over the labelled documents.
* Shapley values by the Hart-Mas-Colell potential: P(empty) = 0, P(S) = (v(S) + sum of P(S without i)) / |S|, computed
  once over the 32 coalitions in the order of their masks; a filter's value is P(all) - P(all without it). Times 120 it
  is its removals summed over all orders, and every potential times 120 is a whole number, so no rounding takes place.

A text is compared with smaller doc_ids by 128 bits of hash: the smallest doc_id of each text is an aggregate, and a
document that holds it is found by a join on text and doc_id together, so a text that fills a third of all rows is
spread over all tasks.

Defined cases: a null text is empty, a null source is the part ''; a row without a doc_id is never a copy of a smaller
one and has no labels; rows repeating a doc_id are documents of their own (with equal texts, none is a copy of the
other); repeated labels of a doc_id count once, any row that says so decides; texts are whole; an empty table has no
parts and gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.session import stage

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_ORDERS = 120


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, part, two hashes of the text and the mask of the conditions A to D that fail, one row a document."""
    t = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("part"), t.alias("t"))
    w = F.expr(r"regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+', 0)")
    rows = rows.select("id", "part", "t", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds"))
    capitals = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]", ""))
    fails = {
        "A": F.col("n") < 50,
        "B": 100 * F.col("kinds").cast("bigint") < 65 * F.col("n").cast("bigint"),
        "C": 100 * capitals.cast("bigint") > 5 * F.length("t").cast("bigint"),
        "D": F.col("t").rlike("[#$%&*|]"),
    }
    mask = sum((F.when(c, _bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0))
    return rows.select("id", "part", F.xxhash64("t").alias("one"), F.xxhash64(F.lit(1), "t").alias("two"), mask.alias("mask"))


def histogram(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """part, mask of all failing filters, and documents with it: n, good, toxic."""
    rows = stage(failures(docs, doc_id, text, source))
    least = rows.groupBy("one", "two").agg(F.min("id").alias("id"))
    marks = labels.select(labels["doc_id"].alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL")
    marks = marks.groupBy("id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    named = rows.where("id IS NOT NULL")
    first = named.join(least, ["one", "two", "id"], "left_semi")
    count = lambda df, sign: df.select("part", "mask", F.lit(sign).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    marked = lambda df, sign: df.select("id", "part", "mask", F.lit(sign).alias("s")).join(marks, "id").select(
        "part", "mask", F.lit(0).alias("n"), F.when(F.col("good"), F.col("s")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("s")).otherwise(0).alias("toxic")
    )
    # All named rows fail E but those that hold the smallest doc_id of their text: these move to the mask without E.
    e = _bit("E")
    moved = lambda make: make(first, 1).unionByName(make(first, -1).withColumn("mask", F.col("mask").bitwiseOR(e)))
    failing = lambda make: make(named, 1).withColumn("mask", F.col("mask").bitwiseOR(e))
    parts = [failing(count), moved(count), count(rows.where("id IS NULL"), 1), failing(marked), moved(marked)]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")])


def games(masks: DataFrame) -> DataFrame:
    """Per part: the number of documents, v over all 32 coalitions (all, good and toxic documents), potentials times 120."""
    hit = lambda s: F.col("mask").bitwiseAND(F.lit(s)) != 0
    v = lambda c: F.array(*[F.coalesce(F.sum(F.when(hit(s), F.col(c))), F.lit(0)) for s in range(_ALL + 1)]).alias(f"v_{c}")
    per = masks.groupBy("part").agg(F.sum("n").alias("total"), v("n"), v("good"), v("toxic"))

    def potential(p: Column, s: Column) -> Column:
        """P(s) from the potentials of all smaller masks."""
        below = sum((F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(p, s - (1 << i))).otherwise(F.lit(0)) for i in range(len(FILTERS))), F.lit(0))
        return F.array_append(p, ((_ORDERS * F.get(F.col("v_n"), s) + below) / F.bit_count(s)).cast("bigint"))

    nothing = F.array(F.lit(0).cast("bigint"))
    return per.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.lit(_ALL)), nothing, potential))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    per = stage(games(histogram(docs, labels, doc_id, text, source)))
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(order), k + 1, before, _bit(f)))
            before |= _bit(f)
    # 600 fixed rows: an inline list, exploded beside each part.
    listed = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(s).alias("s"), F.lit(b).alias("b")) for o, k, s, b in steps])
    at = per.withColumn("x", F.explode(listed)).select("*", "x.*")
    s, b = F.col("s"), F.col("b")
    v = lambda c, m: F.get(F.col(c), m)
    removed = v("v_n", s + b) - v("v_n", s)
    return at.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - v("v_n", s + b)).alias("kept"),
        removed.alias("removed"),
        (v("v_n", b) - removed).alias("redundant"),
        (v("v_n", F.lit(_ALL)) - v("v_n", _ALL - b)).alias("unique_fails"),
        (v("v_good", s + b) - v("v_good", s)).alias("good_lost"),
        (v("v_toxic", s + b) - v("v_toxic", s)).alias("toxic_lost"),
        (v("p", F.lit(_ALL)) - v("p", _ALL - b)).alias("shapley"),
    )
