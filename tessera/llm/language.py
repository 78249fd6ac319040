"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

UNDETERMINED = "und"


WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class CrfConfig:
    """Bounds of the training sample: ``rows_per_label`` documents for each language, but at most about
    ``sample_rows`` in all, and ``words_per_row`` consecutive words from each, from a place that
    depends on the id. Any number of languages is learned; prediction uses whole texts."""

    rows_per_label: int = 400
    sample_rows: int = 25_600
    words_per_row: int = 200
    sequences: int = 4800
    sequence_words: int = 64
    epochs: int = 6
    batch: int = 300
    feature_bits: int = 16
    lexicon_words: int = 300
    l2: float = 1e-6
    rate: float = 0.05
    seed: int = 7
    chunk: int = 64
    block_words: int = 200_000
    cache_words: int = 400_000


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, lower-cased, of the whole text."""
    words = WORD.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    # the word class of ``re`` also has numerals such as fractions
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass
class CrfModel:
    """Emission weights by hashed feature, transition scores, and per-label lexicons."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]
    config: CrfConfig
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "scores": None}

    def feature_ids(self, word: str) -> list[int]:
        """Affixes of one to three letters, inner 2- and 3-grams, the word and its lexicons."""
        marked = f"^{word}$"
        names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
        names += {marked[i : i + k] for k in (2, 3) for i in range(len(marked) - k + 1)}
        names.append(f"w{word}")
        member = self.lexicon.get(word, 0)
        names += [f"l{k}" for k in range(len(self.labels)) if member >> k & 1]
        mask = (1 << self.config.feature_bits) - 1
        return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names]

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature ids of all words in one array, and where each word's begin."""
        parts, sizes = [], []
        for at in range(0, len(words), 4096):  # ids as Python numbers take four times the memory
            lists = [self.feature_ids(w) for w in words[at : at + 4096]]
            sizes += [len(x) for x in lists]
            parts.append(np.fromiter((i for x in lists for i in x), np.int64, sum(sizes[at:])))
        return np.concatenate(parts), np.cumsum([0] + sizes[:-1])

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words, labels); a distinct word is scored once while the cache holds it."""
        if len(self.cache) > self.config.cache_words:
            self.cache, self.scores = {}, None
        cache = self.cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            ids, begins = self.features(new)
            fresh = np.add.reduceat(self.weights[ids], begins, axis=0)
            at = len(cache)
            cache.update(zip(new, range(at, at + len(new))))
            if self.scores is None or len(self.scores) < at + len(new):
                grown = np.empty((2 * (at + len(new)), len(self.labels)), np.float32)
                if at:
                    grown[:at] = self.scores[:at]
                self.scores = grown
            self.scores[at : at + len(new)] = fresh
        return self.scores[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]

    def marginals(self, emissions: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Posterior label probabilities of every word by forward-backward.

        The texts of a block form one chain; ``starts`` marks the first word of each, where
        the transition is a constant, so nothing passes between texts. The chain is cut in
        chunks whose transfer matrices are multiplied side by side; the exact vectors at the
        chunk borders then let all chunks run forward and backward side by side.
        """
        n, k = emissions.shape
        size = self.config.chunk
        chunks = -(-n // size)
        e = np.ones((chunks * size, k), np.float32)
        e[:n] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        e = e.reshape(chunks, size, k)
        fresh = np.ones(chunks * size, bool)
        fresh[:n] = starts
        fresh = fresh.reshape(chunks, size)
        a = np.exp(self.transitions - self.transitions.max()).astype(np.float32)

        product = np.broadcast_to(np.eye(k, dtype=np.float32), (chunks, k, k)).copy()
        for t in range(size):
            step = product @ a
            at = fresh[:, t]
            step[at] = product[at].sum(axis=2, keepdims=True)
            product = step * e[:, t, None, :]
            product /= product.max(axis=(1, 2), keepdims=True)
        enter = np.ones((chunks, k), np.float32)
        leave = np.ones((chunks, k), np.float32)
        for c in range(chunks - 1):
            v = enter[c] @ product[c]
            enter[c + 1] = v / v.max()
        for c in range(chunks - 1, 0, -1):
            v = product[c] @ leave[c]
            leave[c - 1] = v / v.max()
        forward = np.empty_like(e)
        v = enter
        for t in range(size):
            step = v @ a
            at = fresh[:, t]
            step[at] = v[at].sum(axis=1, keepdims=True)
            v = step * e[:, t]
            v /= v.max(axis=1, keepdims=True)
            forward[:, t] = v
        v = leave
        for t in range(size - 1, -1, -1):
            forward[:, t] *= v
            w = v * e[:, t]
            step = w @ a.T
            at = fresh[:, t]
            step[at] = w[at].sum(axis=1, keepdims=True)
            v = step / step.max(axis=1, keepdims=True)
        posterior = forward.reshape(-1, k)[:n]
        return posterior / posterior.sum(axis=1, keepdims=True)

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """The label with most posterior mass over a text's words, and its share."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(lengths.sum())
        if not total or not self.labels:
            return [(UNDETERMINED, 0.0)] * len(texts)
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        starts = np.zeros(total, bool)
        starts[begins[lengths > 0]] = True
        mass = np.zeros((len(texts), len(self.labels)))
        posterior = self.marginals(self.emissions([w for t in texts for w in t]), starts)
        mass[lengths > 0] = np.add.reduceat(posterior.astype(np.float64), begins[lengths > 0], axis=0)
        best = mass.argmax(axis=1)
        return [
            (self.labels[b], float(min(1.0, mass[i, b] / n))) if n else (UNDETERMINED, 0.0)
            for i, (b, n) in enumerate(zip(best.tolist(), lengths.tolist()))
        ]


def train_crf(rows: list[tuple[str, list[str]]], config: CrfConfig = CrfConfig()) -> CrfModel:
    """Fit weights and transitions to spliced sequences of labelled runs of words.

    ``rows`` are (label, words). Each training sequence joins runs of 4 to 24 words from
    random rows, so the transitions see switches of language inside a text.
    """
    labels = sorted({label for label, words in rows if words})
    lexicon: dict[str, int] = {}
    for k, label in enumerate(labels):
        counts: dict[str, int] = {}
        for own, words in rows:
            if own == label:
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
        for w in sorted(counts, key=lambda w: (-counts[w], w))[: config.lexicon_words]:
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    k = len(labels)
    model = CrfModel(labels, np.zeros((1 << config.feature_bits, k), np.float32), np.zeros((k, k), np.float32), lexicon, config)
    if k < 2:
        return model
    rng = np.random.default_rng(config.seed)
    by_label = [[w for own, w in rows if own == label and w] for label in labels]
    types: dict[str, int] = {}
    size = config.sequence_words
    x = np.zeros((config.sequences, size), np.int64)
    y = np.zeros((config.sequences, size), np.int64)
    for s in range(config.sequences):
        at = 0
        while at < size:
            label = int(rng.integers(k))
            words = by_label[label][int(rng.integers(len(by_label[label])))]
            run = min(int(rng.integers(4, 25)), size - at)
            begin = int(rng.integers(max(1, len(words) - run + 1)))
            for w in words[begin : begin + run]:
                x[s, at], y[s, at] = types.setdefault(w, len(types)), label
                at += 1
    ids, begins = model.features(list(types))
    ends = np.concatenate((begins[1:], [len(ids)]))
    squares_w, squares_a = np.full_like(model.weights, 1e-8), np.full_like(model.transitions, 1e-8)
    for _ in range(config.epochs):
        order = rng.permutation(config.sequences)
        for at in range(0, config.sequences, config.batch):
            chosen = order[at : at + config.batch]
            seen, local = np.unique(x[chosen], return_inverse=True)
            counts = ends[seen] - begins[seen]
            firsts = np.cumsum(counts) - counts
            flat = ids[np.arange(counts.sum()) - np.repeat(firsts - begins[seen], counts)]
            table_ = np.add.reduceat(model.weights[flat], firsts, axis=0)
            local = local.reshape(len(chosen), size)
            posterior, pairs = _expectations(table_[local], model.transitions)
            gap = -posterior
            np.put_along_axis(gap, y[chosen][..., None], np.take_along_axis(gap, y[chosen][..., None], 2) + 1, 2)
            gold = np.zeros((k, k))
            np.add.at(gold, (y[chosen][:, :-1].ravel(), y[chosen][:, 1:].ravel()), 1)
            per_type = np.stack([np.bincount(local.ravel(), gap[..., j].ravel(), len(seen)) for j in range(k)], 1)
            spread = np.repeat(per_type, counts, axis=0)
            touched, where = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(where, spread[:, j], len(touched)) for j in range(k)], 1) / len(chosen)
            g -= config.l2 * model.weights[touched]
            squares_w[touched] += g * g
            model.weights[touched] += config.rate * g / np.sqrt(squares_w[touched])
            g = (gold - pairs) / len(chosen)
            squares_a += g * g
            model.transitions += config.rate * g / np.sqrt(squares_a)
    return model


def _expectations(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of words and expected transition counts of sequences of one length."""
    b, size, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    a = np.exp(transitions - transitions.max()).astype(np.float64)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, size):
        v = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = v / v.sum(axis=1, keepdims=True)
    for t in range(size - 2, -1, -1):
        v = (beta[:, t + 1] * e[:, t + 1]) @ a.T
        beta[:, t] = v / v.sum(axis=1, keepdims=True)
    posterior = alpha * beta
    posterior /= posterior.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(size - 1):
        p = alpha[:, t, :, None] * a * (beta[:, t + 1] * e[:, t + 1])[:, None, :]
        pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return posterior, pairs


def fold(column: str, folds: int) -> F.Column:
    return F.crc32(F.col(column).cast("string")) % folds


def fit_language_model(docs: DataFrame, config: CrfConfig = CrfConfig(), folds: int = 5) -> CrfModel:
    """Train on rows of ``docs(doc_id, text, lang)`` outside fold 0 whose lang isn't null.

    Each language takes the ids whose hash lies under its own threshold, which follows from its
    count, so no row is ranked or shuffled by language. Only the counts, one row per language,
    and the sample reach the driver. No such row gives a model that answers ``und``.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return train_crf([], config)
    wanted = max(8, min(config.rows_per_label, config.sample_rows // len(counts)))
    share = F.pmod(F.xxhash64("doc_id", F.lit(config.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    frame = docs.sparkSession.createDataFrame([(k, wanted / n) for k, n in counts.items()], "lang string, below double")
    chosen = known.join(F.broadcast(frame), "lang").where(share < F.col("below"))
    limit = config.words_per_row

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                words = words_of(text.as_py())
                begin = zlib.crc32(str(doc_id).encode()) % max(1, len(words) - limit + 1)
                out.append(words[begin : begin + limit])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["lang"], pa.array(out, pa.list_(pa.string()))], ["doc_id", "lang", "words"]
            )

    # ids that repeat share a hash; the limit bounds the sample even then
    rows = (
        chosen.select(F.col("doc_id").cast("long"), "text", "lang")
        .mapInArrow(sample, "doc_id long, lang string, words array<string>")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "lang", F.xxhash64("words"))
        .limit(2 * wanted * len(counts))
        .collect()
    )
    return train_crf([(r["lang"], list(r["words"])) for r in rows], config)


def predict_language(docs: DataFrame, model: CrfModel, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text, ...)``.

    Only the text decides. ``lang_pred`` is ``und`` with score 0 for null texts and texts
    without letters. Ties go to the language first by name. A null ``doc_id`` is held out, as it is
    never learned from. Repeated rows each return; an empty table gives an empty result, and a model
    of no labelled row ``und`` throughout. Columns besides ``doc_id`` and ``text`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found: list[tuple[str, float]] = []
            block: list[list[str]] = []
            size = 0
            for text in batch["text"]:
                block.append(words_of(text.as_py()))
                size += len(block[-1])
                if size >= own.config.block_words:
                    found += own.predict(block)
                    block, size = [], 0
            found += own.predict(block)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    held = F.coalesce(fold("doc_id", folds) == 0, F.lit(True)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.select("doc_id", "text", "lang"))
    return predict_language(docs.select("doc_id", "text"), model)
