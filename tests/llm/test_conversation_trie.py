"""The trie of conversations against nodes made from all prefixes, and the parentheses against a stack."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsefleet.llm import conversation_trie, parentheses, queries

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [sums[c] for c in children[path]]
        sums[path] = (sum(n for n, _ in below) if below else 1, saved + sum(s for _, s in below))
        digest = hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()
        parent = members[path[:-1]][0] if path else None
        out.append((members[path][0], len(path), parent, len(members[path]), len(children[path]), *sums[path], digest))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def crowd(seed=4, n=300):
    """Conversations with equal beginnings, equal wholes, gaps in the ids, ties, nulls and repeated rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(0, 3 * n, 3):
        size, kind = int(rng.integers(1, 12)), rng.integers(0, 4)
        for t in range(size):
            text = "same" * t if kind == 0 or (kind == 1 and t < 3) else f"{rng.integers(0, 3)}é"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    rows += [(c, t, "user", "hello" * t) for c in range(5001, 5400) for t in range(9)]
    rows += [(7001, None, None, None), (7001, None, "user", None), (7001, 0, None, "x"), (7001, 0, None, "x"), (None, 1, "user", "lost")]
    rows += [(7005, t, "user", f"long {t}") for t in range(700)]
    return rows


@pytest.mark.parametrize("turns", [30, 1 << 18])
def test_odd_rows_equal_all_prefixes(spark, monkeypatch, turns):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", turns)
    rows = crowd()
    frame = spark.createDataFrame(rows, ROWS).repartition(5).selectExpr("*", "1 AS conv", "'x' AS depth", "'y' AS nth", "'z' AS base")
    assert nodes_of(conversation_trie.conversation_trie(frame)) == brute(rows)


def test_empty_table(spark):
    assert conversation_trie.conversation_trie(spark.createDataFrame([], ROWS)).count() == 0


def test_conversations_without_turns_are_members_of_the_root(spark):
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "gone")]
    assert nodes_of(conversation_trie.conversation_trie(spark.createDataFrame(rows, ROWS))) == brute(rows)
    assert brute(rows)[0][:4] == (lone, 0, None, 1)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_all_prefixes(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(queries.op12_conversation_trie(spark, path)) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6), st.sampled_from([0.3, 0.5, 0.8]))
def test_findclose_equals_a_stack(n, seed, deep):
    rng = np.random.default_rng(seed)
    bits, opened, left = [], 0, n
    while left or opened:
        if left and (not opened or rng.random() < deep):
            bits.append(1)
            opened, left = opened + 1, left - 1
        else:
            bits.append(0)
            opened -= 1
    stack, close, leaves = [], {}, 0
    for i, bit in enumerate(bits):
        if bit:
            stack.append(i)
        else:
            close[stack.pop()] = i
    tree = parentheses.Parentheses(np.array(bits))
    places = tree.opens()
    assert tree.findclose(places).tolist() == [close[p] for p in places.tolist()]
    leaves = sum(a == 1 and b == 0 for a, b in zip(bits, bits[1:]))
    assert tree.leaves[-1] == leaves and tree.ranks[-1] == n


def test_least_of_ranges():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 257)
    first = rng.integers(0, 257, 500)
    last = np.minimum(256, first + rng.integers(0, 257, 500))
    assert parentheses.least(values, first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]
