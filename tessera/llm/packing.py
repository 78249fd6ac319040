"""Best-fit packing of tokenized documents into fixed-length training sequences."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@dataclass(frozen=True)
class PackingConfig:
    """``open_bins`` bounds a task's state; ``rows_per_task`` bounds its input.

    A larger task wastes less space at its end, where the bins that are still open close.
    """

    sequence_length: int = 1024
    eos_id: int = 2
    open_bins: int = 4096
    rows_per_task: int = 131_072
    tokenizer: str | None = None


class BestFitPacker:
    """Bounded-space online best-fit.

    At most ``open_bins`` bins are open. ``mask`` has bit ``f`` set if an open bin has ``f``
    free places, so the tightest bin that takes an item is the lowest set bit at or above its
    length, found by one shift and one bit scan. When a new bin would exceed the bound, the
    fullest open bin (the lowest set bit) closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.mask, self.n_open, self.n_bins = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, length: int) -> tuple[int, int]:
        """The bin that takes an item of this length, and the item's offset in it."""
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open == self.open_bins:
                self._take((self.mask & -self.mask).bit_length() - 1)
            self.by_free[left].append(bin_id)
            self.mask |= 1 << left
            self.n_open += 1
        return bin_id, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.n_open -= 1
        return bin_id


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only the first may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


_ENCODERS: dict[str | None, Callable[[str], list[int]]] = {}


def encoder(path: str | None = None) -> Callable[[str], list[int]]:
    """Ids of a text by the byte-level BPE of ``byte_bpe_50k.json``, or of the rank file at ``path``.

    The ``.tiktoken`` file beside it has the same vocabulary as ranks and is four times as fast. The
    vocabulary's added tokens, which only the JSON file lists, are cut out of a text first and give
    their own ids; a test holds the two libraries against each other. A given rank file has none.
    """
    import public_tokenizers
    import tiktoken

    if path not in _ENCODERS:
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added: dict[str, int] = {}
        if path is None:
            with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

        def encode(text: str) -> list[int]:
            if any(t in text for t in added):
                return bpe.encode(text, allowed_special="all")
            return bpe.encode_ordinary(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def tokenize(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """One row per piece of each row of ``docs(doc_id, text)``; ids are counted and hashed here.

    Null text counts as empty: one piece that holds only the end id. The strings of added tokens
    in a text become these tokens, as the tokenizer's own call has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(config.tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py() or "")
                ids.append(config.eos_id)
                raw = np.asarray(ids, "<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(ids), config.sequence_length)):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc_id, k, start, length, crc)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, n_rows: int, config: PackingConfig = PackingConfig()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``sequence_length`` ids.

    Pieces are dealt by a hash of document and piece, so neither a long document nor a hot
    source fills one task; each task packs its own sequences. ``n_rows`` (an estimate of the
    pieces shorter than a sequence) only sets the number of tasks. Rows are sorted within a
    task, so a task that runs again gives the same sequences.
    """
    tasks = max(1, -(-n_rows // config.rows_per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = BestFitPacker(config.sequence_length, config.open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.add(n) for n in batch["length"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array([base + b for b, _ in placed], pa.int64()),
                    pa.array([o for _, o in placed], pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    dealt = pieces.withColumn("deal", F.xxhash64("doc_id", "piece", "start"))
    return (
        dealt.repartition(tasks, "deal")
        .sortWithinPartitions("deal", "doc_id", "piece", "ids_crc32")
        .drop("deal")
        .mapInArrow(run, PACKED)
    )


def best_fit_packing(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """Pack ``docs(doc_id, text, ...)`` into sequences of ``config.sequence_length`` token ids.

    Every row of ``docs`` is one document, also if ids or texts repeat. Null and empty texts
    give one piece with the end id alone. Null ids stay null. Columns besides ``doc_id`` and
    ``text`` are not read. An empty table gives an empty result.
    """
    return pack(tokenize(docs, config), docs.count(), config)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))
