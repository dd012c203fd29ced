"""Words, tokens, archives and the operators on texts, against brute force and on odd tables."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsefleet.llm import langid, licenses, phrase_index, queries, rans, simhash, token_files, warc
from pulsefleet.llm.common import SPACES, counted_before, packed, slices, split_words
from pulsefleet.llm.tokenizer import WordTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like helpers of the operators.
CLASHES = "fp string, key string, row string, component_id int, hist string, `start` string, epoch int, __text string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, ties, and columns with clashing names."""
    long_text = " ".join(f"word{i % 977} Thing," for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and looked at the dog for a very long time.", "en", "src1"),
        (2, "The cat sat on the mat and looked at the dog for a very long time.", "en", "src1"),
        (2, "The cat sat on the mat and looked at the dog for a very long time.", "en", "src1"),
        (3, None, None, None),
        (4, "", "en", "src2"),
        (5, "  \n\t ", "en", "src2"),
        (6, long_text, "en", "src2"),
        (7, long_text + " tail", "de", "src3"),
        (8, "12 34 56!", "de", "src3"),
        (9, "Ünïcödé Wörter für die Katze, ΑΒΓ €", "de", None),
        (None, "no id here", "fr", "src4"),
        (None, None, "fr", "src4"),
        (10, "x", None, "src4"),
    ]
    frame = docs_frame(spark, rows)
    names = [c.split()[0].strip("`") for c in CLASHES.split(", ")]
    return frame.selectExpr("*", *[f"'c{i}' AS `{n}`" for i, n in enumerate(names)])


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


# -- helpers -----------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZé \t\n.,ß0", max_size=12)), max_size=8))
def test_split_words(texts):
    words = split_words(pa.array(texts, pa.string()), SPACES)
    raw = [bytes(words.data[a:b]).decode() for a, b in zip(words.offsets, words.offsets[1:])]
    for text, low, high in zip(texts, words.first, words.first[1:]):
        assert raw[low:high] == re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def test_counted_before_is_exact_for_a_heavy_key(spark):
    rows = spark.range(3000).selectExpr("if(id < 2500, 'hot', concat('k', id % 7)) AS k", "xxhash64(id) AS h", "id % 5 + 1 AS v")
    got = counted_before(rows, ["k"], rows["h"], rows["v"], "before", bits=4).toPandas().sort_values(["k", "h"])
    assert (got.groupby("k").v.cumsum() - got.v == got.before).all()


def test_packed_keys_of_equal_rows_only(odd):
    keys = packed(odd).groupBy("key").count().toPandas()
    assert len(keys) == 12 and sorted(keys["count"])[-1] == 2


# -- near-duplicates -----------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable, by rows (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(doc_id)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(prints))]


def near_rows(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_near_duplicates_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    expected = [(d, f"{fp:016x}", c) for (d, fp), c in zip(prints, brute_components(prints))]
    assert near_rows(tuple(r) for r in queries.op8_near_duplicates(spark, data).collect()) == near_rows(expected)


def test_near_duplicates_of_odd_rows(odd, none):
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in odd.collect()]
    expected = [(d, f"{fp:016x}", c) for (d, fp), c in zip(prints, brute_components(prints))]
    assert near_rows(tuple(r) for r in simhash.near_duplicates(odd).collect()) == near_rows(expected)
    assert simhash.near_duplicates(none).count() == 0


def test_crowds_are_linked_without_pairs(spark):
    """Many fingerprints share a half; the classes are those of all pairs."""
    rng = np.random.default_rng(5)
    half = 0x12345678 << 32
    values = {int(half | v) for v in rng.integers(0, 1 << 10, 300)} | {int(v) for v in rng.integers(0, 1 << 62, 50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    got = simhash.classes(spark.createDataFrame([(v,) for v in signed], "fp long")).toPandas()
    expected = brute_components([(v, v & (1 << 64) - 1) for v in signed])
    mine = got.set_index("fp").root
    by_mine, by_brute = {}, {}
    for v, c in zip(signed, expected):
        by_mine.setdefault(mine[v], set()).add(v)
        by_brute.setdefault(c, set()).add(v)
    assert sorted(map(sorted, by_mine.values())) == sorted(map(sorted, by_brute.values()))


def test_variants_meet_for_every_small_difference(spark):
    base = 0x0F1E2D3C4B5A6978
    near = [base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(i, 64, 7)]
    for other in near:
        value = other - (1 << 64) if other >> 63 else other
        frame = spark.createDataFrame([(base,), (value,)], "fp long").distinct()
        held = frame.select("fp", simhash._variants().alias("v")).groupBy("v").count().where("count > 1").count()
        assert held or value == base
        break  # one round trip through Spark; the rest below without
    for other in near:
        a, b = base, other
        halves = [((a >> s) ^ (b >> s)) & 0xFFFFFFFF for s in (0, 32)]
        assert any(h.bit_count() <= 1 for h in halves)


def test_one_document_of_each_group_stays(odd, none):
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    near = simhash.near_duplicates(odd).toPandas()
    assert kept.count() == near.groupby("component_id", dropna=False).ngroups
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in ids if i is not None} <= set(near.component_id.dropna().astype(int))
    assert simhash.deduplicated(none).count() == 0


# -- decontamination ---------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_contamination(docs, items, size=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return out


ITEMS = [
    (1, "the cat sat on the mat and looked at the dog for a while"),
    (2, "word5 thing word6 thing word7 thing word8 thing word9 thing word10 thing"),
    (3, "id here"),
    (3, "looked at"),
    (4, None),
    (5, " ... "),
    (None, "die katze"),
]


@pytest.mark.parametrize("block_words", [1 << 21, 40])
def test_contamination_equals_brute_force(spark, odd, none, block_words):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS key", "2 AS n_hit")
    index = phrase_index.build(odd, "doc_id", "text", block_words)
    got = phrase_index.search(index, benchmark).collect()
    mine = [(r.key, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got]
    expected = brute_contamination([(r.doc_id, r.text) for r in odd.collect()], ITEMS)
    assert near_rows(mine) == near_rows(expected)
    assert all(r.n_hit == sum(s["to"] - s["from"] for s in r.spans) for r in got)


def test_contamination_of_odd_tables(spark, odd, none):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = brute_contamination([(r.doc_id, r.text) for r in odd.collect()], ITEMS)
    assert near_rows(tuple(r) for r in phrase_index.contamination(odd, benchmark).collect()) == near_rows(expected)
    assert phrase_index.contamination(none, benchmark).count() == 0
    assert phrase_index.contamination(odd, benchmark.where("false")).where("contaminated").count() == 0
    kept = phrase_index.decontaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == sum(not e[-1] for e in expected)


def test_test_sets_in_parts_and_proximity(spark, odd, monkeypatch):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = phrase_index.contamination(odd, benchmark).collect()
    monkeypatch.setattr(phrase_index, "PART_WINDOWS", 2)
    assert len(phrase_index.windows_of(benchmark, "item_id", "text").inputFiles()) > 2
    assert near_rows(map(tuple, phrase_index.contamination(odd, benchmark).collect())) == near_rows(map(tuple, whole))
    docs = docs_frame(spark, [(1, "alpha beta x gamma", None, None), (2, "alpha y y y y gamma beta", None, None)])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    parts = phrase_index.windows_of(items, "item_id", "text").collect()
    assert [tuple(r) for r in parts] == [("alpha beta gamma", "1")]
    index = phrase_index.build(docs, "doc_id", "text")
    near = {r.key: r.n_hit for r in phrase_index.search(index, items, slack=1).collect()}
    exact = {r.key: r.n_hit for r in phrase_index.search(index, items).collect()}
    assert near[1] == 3 and near[2] == 0 and exact == {1: 0, 2: 0}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, (1 << 42) - 1), max_size=50))
def test_gaps_round_trip(values):
    values = np.array(values, dtype=np.int64)
    assert (phrase_index.unpack_gaps(phrase_index.pack_gaps(values)[0]) == values).all()


# -- tokens ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return WordTokenizer(queries.tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ.,!?'s;:é\u0331\u0301 H1٣<|>-\n\u3000ǅẞ", max_size=30)), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(coder, texts):
    ids, ends = coder.encode(pa.array(texts, pa.string()))
    for text, low, high in zip(texts, ends, ends[1:]):
        assert ids[low:high].tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_special_tokens_in_texts(coder):
    texts = ["a <|endoftext|>b", "<|STARTOFTEXT|> c", "plain Words."]
    ids, ends = coder.encode(pa.array(texts))
    for text, low, high in zip(texts, ends, ends[1:]):
        assert ids[low:high].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 5), st.integers(1, 9), st.integers(1, 40), st.integers(0, 1000))
def test_coder_round_trip(blocks, steps, symbols, seed):
    rng = np.random.default_rng(seed)
    lanes, every = 4, 3
    ids = (rng.zipf(1.5, (blocks, steps * lanes)) % symbols).astype(np.uint32) * 7
    table = rans.Frequencies.of(*np.unique(ids, return_counts=True))
    assert table.shares.sum() == 1 << table.bits
    for row, block in zip(ids, rans.encode(ids, table, lanes, every)):
        for mark, (place, states) in enumerate(zip(block.places, block.states)):
            count = min(every, steps - mark * every)
            got = rans.decode(block.words, np.array([place]), states[None], count, table)[0]
            assert (got == row[mark * every * lanes :][: count * lanes]).all()


def test_files_decode_from_any_checkpoint_and_check_their_sums():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 5000) % 3000).astype(np.uint32)
    layout = token_files.Layout(block=1024, lanes=16, every=8, at_once=2)
    table = rans.Frequencies.of(*np.unique(ids, return_counts=True))
    data = token_files.file_bytes(ids, [5, None, 7], np.array([2000, 0, 3000]), table, layout)
    opened = token_files.TokenFile(data)
    assert opened.doc_ids == [5, None, 7] and (opened.ids(table, at_once=3) == ids).all()
    assert (opened.stretch(1, 3, table) == ids[1024 + 3 * 128 : 1024 + 4 * 128]).all()
    last = len(opened.blocks) - 1
    assert (opened.stretch(last, 0, table) == ids[last * 1024 :][:128]).all()
    broken = bytearray(data)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(broken)).ids(table)


def brute_tokens(coder, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array(coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_brute_force(spark, data, coder):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op2_token_ids(spark, data).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_tokens(coder, rows)


def test_token_files_of_odd_rows(odd, none, coder):
    small = token_files.Layout(block=512, lanes=8, every=16, file_tokens=300)
    got = token_files.encoded_and_read(odd, queries.tokenizer_path(), 2, small).collect()
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd.collect()), key=lambda d: (d is not None, d))
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    expected = {(d, n, c) for d, _, n, c in brute_tokens(coder, [(r.doc_id, r.text) for r in odd.collect()])}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows} == expected
    assert token_files.encoded_and_read(none, queries.tokenizer_path(), 2).count() == 0


# -- language ----------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op10_languages(spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = docs[docs.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_of_odd_rows(spark, odd, none):
    got = langid.identified(odd).toPandas()
    assert len(got) == odd.count()
    unknown = {3, 4, 5, 8}
    assert set(got[got.lang_pred == "und"].doc_id.dropna().astype(int)) == unknown
    assert (got[got.lang_pred == "und"].score == 0).all()
    assert langid.identified(none).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert set(langid.identified(unlabelled).toPandas().lang_pred) == {"und"}
    kept = langid.in_known_language(odd)
    assert kept.columns == odd.columns
    assert not {3, 4, 5, 8} & {r.doc_id for r in kept.collect()}


# -- licences ----------------------------------------------------------------------------------------


def test_license_bounds_lose_nothing():
    texts = ["Released under the MIT License.\nreleased under the mit license", None, "", "one", "x\n\nLicensed under\nCC BY-NC 4.0.\n\ny"]
    found = list(licenses.Scanner(licenses.TEMPLATES, 0.8).scan(pa.array(texts, pa.string())))
    names = licenses.Scanner(licenses.TEMPLATES, 0.8).names
    assert [(t, a, b, names[k], round(d, 3)) for t, a, b, k, d in found] == [
        (0, 0, 0, "MIT", 1.0),
        (0, 1, 1, "MIT", 1.0),
        (4, 0, 5, "CC-BY-NC-4.0", 0.857),
        (4, 2, 3, "CC-BY-NC-4.0", 1.0),
        (4, 3, 3, "CC-BY-NC-4.0", 0.8),
    ]


def test_long_licenses_in_paragraphs(spark, odd, none):
    text = dict(licenses.TEMPLATES)["MIT text"]
    lines = "\n".join(text[i : i + 60] for i in range(0, len(text), 60)).replace("\n ", "\n")
    changed = text.replace("Software", "Program", 2)
    docs = docs_frame(spark, [(1, f"Intro.\n\n{changed}\n\nEnd.", None, None), (2, lines.replace("sub\n", "sub"), None, None)])
    got = {(r.doc_id, r.license) for r in licenses.scanned(docs).collect()}
    assert got == {(1, "MIT text"), (2, "MIT text")}
    assert licenses.scanned(odd).count() == 0 and licenses.scanned(none).count() == 0


# -- archives ----------------------------------------------------------------------------------------


def brute_archives(rows):
    payloads = [(i, (html or "").encode()) for i, html in rows]
    largest = {}
    for i, p in payloads:
        if len(p) >= 1000 and i is not None:
            largest[p] = max(i, largest.get(p, i))
    count = {p: sum(q == p for _, q in payloads) for _, p in payloads}
    out = []
    for i, p in payloads:
        best = largest.get(p) if len(p) >= 1000 and count[p] > 1 else None
        other = best is not None and i != best
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if other else "response", best if other else None))
    return out


def test_archives_equal_brute_force(spark):
    rows = [(1, "u", "é" * 600), (2, None, "é" * 600), (2, "u", "é" * 600), (None, "u\r\nX: y", "é" * 600)]
    rows += [(3, "u", "b" * 999), (4, "u", "b" * 999), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS digest")
    got = [tuple(r) for r in warc.archived_pages(pages).collect()]
    assert near_rows(got) == near_rows(brute_archives([(i, h) for i, _, h in rows]))
    assert warc.archived_pages(pages.where("false")).count() == 0


def test_normaliser_streams_members_and_checks_ends(monkeypatch):
    import io

    monkeypatch.setattr(warc, "CHUNK", 37)
    whole = b"".join(warc.page_record(i, f"http://x/{i}", b"p" * (i * 50), "d", None) for i in range(9))
    for source in (warc.member(whole), b"".join(warc.member(whole[k : k + 100]) for k in range(0, len(whole), 100))):
        out = io.BytesIO()
        index = list(warc.normalise(io.BytesIO(source), out))
        assert [e["target"] for e in index] == [f"http://x/{i}" for i in range(9)]
        for i, entry in enumerate(index):
            data = out.getvalue()[entry["offset"] : entry["offset"] + entry["length"]]
            fields, block = warc.parse(zlib.decompress(data, 31))
            assert fields["warc-page-id"] == str(i) and block.endswith(b"\r\n\r\n" + b"p" * (i * 50))
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(warc.member(whole[:-20])), io.BytesIO()))


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (0, 5, 50, 1, 1, 1)] + [None]})
    parts = list(slices(batch, "t", 10))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 1
