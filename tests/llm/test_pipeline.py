"""The pipeline stage by stage against a plain Python version, each stage on what the plain one before it kept."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pulsefleet.llm import queries
from pulsefleet.llm.common import packed
from tests.llm.test_overlap import brute_kept
from tests.llm.test_texts import brute_contamination


def split(given, children):
    """What each child (name, supply, weight) gets: shortages go to the others by weight, remainders to the first."""
    order = sorted(children, key=lambda c: (Fraction(c[1], c[2]), c[0]))
    out, weight = {}, sum(w for _, _, w in order)
    while order and order[0][1] * weight <= given * order[0][2]:
        name, supply, own = order.pop(0)
        out[name], given, weight = supply, given - supply, weight - own
    parts = [given * w // weight for _, _, w in order]
    for i, (name, _, _) in enumerate(order):
        out[name] = parts[i] + (i < given - sum(parts))
    return out


def plain_mixing(rows, share, weights, seed):
    """rows: (doc_id, ident, text, lang, source). Ids of the documents that begin within their leaf's budget."""
    leaves = defaultdict(list)
    for doc_id, ident, text, lang, source in rows:
        n = len(re.findall(r"[^ \t\n\r]+", text or ""))
        domain = "none" if source is None else "d" + source[-1:]
        if n:
            leaves[domain, lang or "none", source or "none"].append((hashlib.md5(f"{seed}:0:{ident}".encode()).hexdigest()[:15], doc_id, n))
    supply = defaultdict(int)
    for leaf, docs in leaves.items():
        for depth in range(4):
            supply[leaf[:depth]] += sum(n for _, _, n in docs)
    budget = {(): supply[()] * share // 1000}
    for depth, level in enumerate(("domain", "lang", "source")):
        for upper in [k for k in budget if len(k) == depth]:
            children = [(k, supply[k], weights.get(level, {}).get(k[-1], 1)) for k in supply if len(k) == depth + 1 and k[:-1] == upper]
            budget |= split(budget[upper], children)
    kept = []
    for leaf, docs in leaves.items():
        start = 0
        for _, doc_id, n in sorted(docs):
            if start < budget[leaf]:
                kept.append(doc_id)
            start += n
    return sorted(kept)


def ids(docs):
    return sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_equal_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixing", "token_ids"]

    # The language stage is a trained model: it keeps nearly all, whole rows, and no text without letters.
    known = corpus_pipeline.stored(stages["language"](spark, docs, data))
    assert known.exceptAll(docs).isEmpty() and known.count() >= 0.95 * docs.count()
    assert known.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).isEmpty()

    rows = [(r.doc_id, r.text) for r in known.select("doc_id", "text").collect()]
    single = corpus_pipeline.stored(stages["near_duplicates"](spark, known, data))
    want = [i for none, i in brute_kept(rows) if not none]
    assert ids(single) == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    texts = dict(rows)
    clean = corpus_pipeline.stored(stages["decontamination"](spark, single, data))
    want = [row[0] for row in brute_contamination([(i, texts[i]) for i in want], items) if not row[-1]]
    assert ids(clean) == want and len(want) < len(ids(single))

    keyed = packed(clean).select("row.doc_id", F.concat_ws("-", "key.a", "key.b"), "row.text", "row.lang", "row.source").collect()
    plan = queries.MIXTURE
    want = plain_mixing(map(tuple, keyed), corpus_pipeline.MIXED_SHARE, plan.weights, plan.seed)
    mixed = corpus_pipeline.stored(stages["mixing"](spark, clean, data))
    assert ids(mixed) == want and len(want) < len(keyed)

    tokenizer, start, expected = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for doc_id in want:
        coded = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, queries.END_ID]
        expected.append((doc_id, start, len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
        start += len(coded)
    got = stages["token_ids"](spark, mixed, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected
