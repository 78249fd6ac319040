"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize, table

ALL_BITS = (1 << 64) - 1


@dataclass(frozen=True)
class SimHashConfig:
    """``bucket_limit``: a bucket with more distinct fingerprints is divided once more."""

    shingle_words: int = 3
    seed: int = 42
    radius: int = 2
    bucket_limit: int = 4096


def covering_masks(radius: int, bits: int = ALL_BITS) -> list[int]:
    """Masks over the set bits of ``bits``; any ``radius`` of them avoid at least one mask.

    Bit ``i`` has a nonzero label of ``radius + 1`` binary digits, and mask ``v`` keeps the bits
    whose label has an odd inner product with ``v``. The labels of ``radius`` differing bits
    span at most ``radius`` dimensions, so some nonzero ``v`` is orthogonal to all of them:
    its mask keeps none of the differing bits, and the pair collides in that table.
    """
    codes = (1 << (radius + 1)) - 1
    places = [i for i in range(64) if bits >> i & 1]
    return [
        sum(1 << place for k, place in enumerate(places) if ((k % codes + 1) & v).bit_count() & 1)
        for v in range(1, codes + 1)
    ]


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one text; A-Z are lower-cased, other letters stay."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        hashes = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536])),
            np.uint64,
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs``; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), config.shingle_words, config.seed) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucket_edges(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one bucket within ``radius``; at most n - 1 edges."""
    parent = list(range(len(values)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius)
        for j in (near + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, j))
    return edges


def link(distinct: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of ``distinct(fp)`` in the radius.

    Each fingerprint enters one table per mask. A bucket over ``bucket_limit`` is divided by
    covering masks of the bits that its own mask leaves open: members agree on the kept bits,
    so the guarantee holds again in the smaller space. After two divisions a bucket has at
    most 12 open bits, 4096 values. All levels are exact, none drops a row.
    """
    radius = config.radius
    first = covering_masks(radius)
    levels = _enter(distinct.withColumn("path", F.lit("")), [(str(v), m) for v, m in enumerate(first)], ALL_BITS)
    settled = []
    masks = {str(v): m for v, m in enumerate(first)}
    for _ in range(2):
        full = (
            levels.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > config.bucket_limit).drop("n")
        )
        settled.append(levels.join(full, ["path", "key"], "left_anti"))
        crowded = levels.join(full, ["path", "key"], "left_semi").select("fp", "path")
        deeper = {}
        for path, mask in masks.items():
            for v, below in enumerate(covering_masks(radius, ALL_BITS ^ mask)):
                deeper[f"{path}{v}"] = (path, mask | below)
        levels = _divide(crowded, deeper)
        masks = {p: m for p, (_, m) in deeper.items()}
    entries = settled[0].union(settled[1]).union(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_values = None, []

        def close() -> pa.RecordBatch:
            values = np.asarray(open_values, np.int64)
            found = bucket_edges(values, radius)
            return pa.RecordBatch.from_arrays(
                [pa.array([open_values[i] for i, _ in found], pa.int64()), pa.array([open_values[j] for _, j in found], pa.int64())],
                ["a", "b"],
            )

        for batch in batches:
            for path, key, fp in zip(batch["path"].to_pylist(), batch["key"].to_pylist(), batch["fp"].to_pylist()):
                if (path, key) != held:
                    if len(open_values) > 1:
                        yield close()
                    held, open_values = (path, key), []
                open_values.append(fp)
        if len(open_values) > 1:
            yield close()

    return (
        entries.repartition("path", "key")
        .sortWithinPartitions("path", "key", "fp")
        .mapInArrow(run, "a long, b long")
    )


def _enter(rows: DataFrame, masks: list[tuple[str, int]], _all: int) -> DataFrame:
    choices = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(_signed(m)).alias("mask")) for p, m in masks))
    return rows.select("fp", F.explode(choices).alias("t")).select(
        "fp", "t.path", F.col("fp").bitwiseAND(F.col("t.mask")).alias("key")
    )


def _divide(rows: DataFrame, deeper: dict[str, tuple[str, int]]) -> DataFrame:
    choices = F.array(
        *(
            F.struct(F.lit(p).alias("path"), F.lit(above).alias("above"), F.lit(_signed(m)).alias("mask"))
            for p, (above, m) in deeper.items()
        )
    )
    return (
        rows.withColumn("t", F.explode(F.filter(choices, lambda t: t["above"] == F.col("path"))))
        .select("fp", "t.path", F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    )


def simhash_near_dedup(docs: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    Fingerprints at ``radius`` or fewer differing bits link; ``component_id`` is the smallest
    ``doc_id`` reachable. Texts without words have fingerprint zero and link like any other.
    Rows of one fingerprint are combined before any table is built, so copies, however many,
    cost one entry. Rows with a null id get the component of their fingerprint (null if no
    row there has an id). Repeated rows each return. Other columns are not read.
    """
    prints = materialize(fingerprints(docs, config), "simhash")
    return components_of(prints, config)


def components_of(prints: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    entries = materialize(by_print, "simhash-distinct")
    roots = connected_components(link(entries.select("fp"), config))
    rooted = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(names, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
