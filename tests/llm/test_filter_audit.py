"""The filter audit against filters that run one after the other, document by document."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from pulsefleet.llm import filter_audit, queries


def brute(docs, labels):
    """The contract's rows from (doc_id, text, source) and (doc_id, quality, toxic)."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, bad = defaultdict(int), defaultdict(int)
    for i, quality, toxic in labels:
        if i is not None:
            good[i] |= quality == 1
            bad[i] |= toxic == 1
    flags = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": i is not None and i > first[text],
        }
        flags.append((source or "", fails, good[i] if i is not None else 0, bad[i] if i is not None else 0))
    rows, shapley = [], Counter()
    for part in {p for p, *_ in flags}:
        own = [f for f in flags if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, name in enumerate(order, 1):
                gone = [f for f in alive if f[1][name]]
                alive = [f for f in alive if not f[1][name]]
                failed = sum(f[1][name] for f in own)
                alone = sum(f[1][name] and sum(f[1].values()) == 1 for f in own)
                shapley[part, name] += len(gone)
                rows.append((part, order, step, len(alive), len(gone), failed - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone), name))
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in rows)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def audited(docs, labels):
    steps = filter_audit.audit(filter_audit.flagged(docs, labels), "part", "ABCDE", ["quality", "toxic"])
    return steps.withColumnsRenamed({"lost_quality": "good_lost", "lost_toxic": "toxic_lost"})


def test_query_equals_filters_in_turn(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(queries.op11_filter_audit(spark, data)) == brute(docs, labels)


def test_odd_rows(spark):
    long_text = " ".join(f"word{i}" for i in range(30_000))
    docs = [
        (1, "same text here", "a"), (2, "same text here", "b"), (2, "same text here", "b"), (1, "same text here", "a"),
        (3, None, None), (4, "", ""), (5, "  \n\t ", "a"), (6, long_text, "a"), (7, long_text + " X#", "b"), (8, "A " * 300, "b"),
        (None, "same text here", "a"), (None, None, None), (9, "É" * 90 + "AB", "c"), (10, "É" * 98 + "AB", "c"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, None), (None, 1, 1), (7, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'x' AS digest", "1 AS id", "'y' AS part", "'z' AS A")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS id")
    assert rows_of(audited(frame, marks)) == brute(docs, labels)
    assert audited(frame.where("false"), marks).count() == 0
    assert rows_of(audited(frame, marks.where("false"))) == brute(docs, [])


def test_any_number_of_filters_and_chosen_orders(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), ("p", False, True), (None, False, False)], "k string, x boolean, y boolean")
    got = filter_audit.audit(rows, "k", "xy", orders=["yx"]).orderBy(F.col("part").asc_nulls_first(), "step").collect()
    assert [(r.part, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got] == [(None, 1, 0, 0, 0, 0), (None, 1, 0, 0, 0, 0), ("p", 1, 2, 0, 1, 2), ("p", 0, 1, 1, 1, 1)]


def test_contraction_selects_along_each_axis():
    tensor = np.arange(8).reshape(2, 2, 2)
    choices = np.array([[(1, 0), (0, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)]])
    assert filter_audit.contracted(tensor, choices).tolist() == [2 + 3, 28]
