"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits: bit i is set if it is set in more than half of the XXH64 hashes of the text's
word shingles. Two texts link if their fingerprints differ in at most two bits.

Finding the links: a fingerprint is cut into two segments of 32 bits. Of two fingerprints that link, at
least one segment differs in at most one bit, so they agree in one of the segment's 32 variants with
one bit struck out. Distinct fingerprints are indexed under their 64 variants; equal variants meet.

* A variant held by two fingerprints gives one candidate pair, which is verified.
* A variant held by more (a crowd: copies with small changes, or texts that agree by chance) would give
  all pairs of the crowd. Its members are indexed once more, under their 65 neighbours at a distance of
  at most one bit, themselves included. Two fingerprints share a neighbour exactly if they differ in
  at most two bits, so a star from the smallest member of each neighbour holds every link's ends
  together. A neighbour has at most 65 members, whatever the crowd's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefleet.llm.common import SPACES, components, packed, slices, split_words, stored

SEED = 42
SHINGLE = 3
SEGMENT = 32
DISTANCE = 2

#: Variants of crowds that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_VARIANTS = 4_000_000
#: Fingerprints whose variants one task makes.
TASK_FINGERPRINTS = 16_384

#: For a byte, its eight bits spread over the bytes of a word, so that 255 such words can be added.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text (hashes first[d] to first[d + 1] - 1) the bits set in over half of the hashes; none: zero."""
    sizes = np.diff(first)
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # Runs of at most 255 hashes of one text.
    runs = -(-sizes[full] // 255)
    run_text = np.repeat(np.arange(len(full)), runs)
    in_text = np.arange(len(run_text)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = first[full][run_text] + 255 * in_text
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(spread, starts, axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(counts, np.cumsum(runs) - runs, axis=0, dtype=np.int64)
    bits = 2 * counts > sizes[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    words = split_words(texts, SPACES)
    sizes = np.diff(words.offsets)
    # The words of all texts, each followed by one blank.
    stops = np.cumsum(sizes + 1)
    buffer = np.full(int(stops[-1]) if len(stops) else 0, 0x20, dtype=np.uint8)
    buffer[np.arange(len(words.data)) + np.repeat(np.arange(len(sizes)), sizes)] = words.data
    per_text = np.diff(words.first)
    shingles = np.where(per_text == 0, 0, np.maximum(per_text - shingle + 1, 1))
    text_of = np.repeat(np.arange(len(per_text)), shingles)
    ends = np.concatenate([[0], np.cumsum(shingles)])
    begin = words.first[text_of] + np.arange(ends[-1]) - ends[text_of]
    end = begin + np.minimum(shingle, per_text)[text_of] - 1
    view, hashed = memoryview(buffer), xxhash.xxh64_intdigest
    low, high = (stops - sizes - 1)[begin].tolist(), (stops - 1)[end].tolist()
    hashes = np.fromiter((hashed(view[a:b], SEED) for a, b in zip(low, high)), np.uint64, len(low))
    return _majority(hashes, ends)


def fingerprinted(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the fingerprint's bits as a signed long)."""
    schema = df.select(*keep).schema.add("fp", "long")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                fp = pa.array(fingerprints_of(piece.column(text)).view(np.int64))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], fp], names=[*keep, "fp"])

    return df.mapInArrow(of, schema)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants() -> Column:
    """One long per segment and struck-out bit: the segment's number, the bit's number, the other bits."""
    out = []
    for k in range(64 // SEGMENT):
        part = F.shiftrightunsigned("fp", SEGMENT * k).bitwiseAND(F.lit((1 << SEGMENT) - 1).cast("long"))
        for i in range(SEGMENT):
            rest = part.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << i)).cast("long"))
            out.append(rest.bitwiseOR(F.lit((k * SEGMENT + i) << SEGMENT).cast("long")))
    return F.explode(F.array(*out))


def _neighbours() -> Column:
    one = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
    return F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(x) for x in one]))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``: whoever link in two bits are connected by them."""
    variants = distinct.select("fp", _variants().alias("variant"))
    held = stored(
        variants.groupBy("variant")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1")
    )
    pairs = held.where("n = 2").where(_distance("a", "b") <= DISTANCE).select("a", "b").distinct()
    crowded = held.where("n > 2").select("variant")
    # Crowds are few beside the variants: while their list is small it goes to the variants, not the reverse.
    if crowded.count() <= BROADCAST_VARIANTS:
        crowded = F.broadcast(crowded)
    crowd = variants.join(crowded, "variant", "left_semi").select("fp").distinct()
    near = crowd.select("fp", _neighbours().alias("near"))
    smallest = F.min("fp").over(Window.partitionBy("near"))
    stars = near.select(smallest.alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()
    return pairs.union(stars)


def classes(prints: DataFrame) -> DataFrame:
    """The class of each distinct fingerprint of ``prints``: fp, root."""
    distinct = stored(prints.select("fp").distinct())
    tasks = -(-distinct.count() // TASK_FINGERPRINTS)
    joined = components(links(distinct.repartition(max(1, tasks))))
    return distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach, itself included. Null and empty texts have no
    words: their fingerprint is zero and links like any other. Repeated rows are returned each. A null
    doc_id is never the smallest; a component without any other has a null component_id. Other columns
    of ``docs`` are not read.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = stored(fingerprinted(docs, "text", ["doc_id"]))
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    class_of = stored(classes(prints).join(ids, "fp"))
    least = class_of.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = class_of.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row per component: that with the smallest doc_id, or any of equal rows.

    Rows with a null doc_id stay only if no row of their component has an id; of several rows with the
    smallest id the one with the smallest hash stays.
    """
    rows = packed(docs).select("row", "key", F.col(f"row.`{text}`").alias("text"), F.col(f"row.`{doc_id}`").alias("id"))
    prints = stored(fingerprinted(rows.select("key", "id", "text"), "text", ["key", "id"]))
    best = F.struct(F.col("id").isNull(), "id", "key")
    class_of = stored(classes(prints).join(prints.groupBy("fp").agg(F.min(best).alias("best")), "fp"))
    stays = class_of.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias("key"))
    kept = rows.select("row", "key").join(stored(stays), "key", "left_semi")
    # Equal rows have equal keys; the join has put them together.
    return kept.dropDuplicates(["key"]).select("row.*")
