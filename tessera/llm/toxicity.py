"""Toxicity scores from a classifier regularised by counterfactual identity swaps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import fold
from .storage import table

WORD = re.compile(r"[^\W\d_]+")

#: Neutral group mentions by language; a term is swapped for the others of its row.
IDENTITY_TERMS = {
    "en": (
        ("women", "men", "girls", "boys", "transgender", "nonbinary"),
        ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("gay", "lesbian", "straight", "bisexual", "queer"),
        ("young", "old", "elderly", "teenage"),
        ("american", "mexican", "german", "french", "chinese", "turkish"),
        ("disabled", "blind", "deaf"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
        ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
        ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
        ("amerikaner", "franzosen", "polen", "syrer", "türken", "chinesen"),
        ("behinderte", "blinde", "gehörlose"),
    ),
    "es": (
        ("mujeres", "hombres", "niñas", "niños"),
        ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
        ("negros", "blancos", "asiáticos", "africanos", "europeos"),
        ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
        ("americanos", "mexicanos", "alemanes", "gitanos", "turcos", "chinos"),
        ("discapacitados", "ciegos", "sordos"),
    ),
    "fr": (
        ("femmes", "hommes", "filles", "garçons"),
        ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
        ("noirs", "blancs", "asiatiques", "africains", "européens"),
        ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"),
        ("américains", "mexicains", "allemands", "arabes", "turcs", "chinois"),
        ("handicapés", "aveugles", "sourds"),
    ),
}
#: Neutral sentences that mention a group.
MENTIONS = {
    "en": ("my {} friends came to dinner", "a {} family lives in our street", "they are {}"),
    "de": ("hier wohnen viele {}", "{} und andere gäste kamen zum essen", "sie sind {}"),
    "es": ("los {} de nuestra calle vinieron a cenar", "hay muchos {} en el barrio", "son {}"),
    "fr": ("les {} de notre rue sont venus dîner", "il y a des {} dans le quartier", "ce sont des {}"),
}

GROUPS = tuple(group for groups in IDENTITY_TERMS.values() for group in groups)
TERMS = {t for group in GROUPS for t in group}
#: Endings that a term's other forms have in its place, by language and the term's own ending.
ENDINGS = {
    "en": {"": ("s",), "s": ("",)},
    "de": {"e": ("en", "er", "es", "", "in", "innen"), "en": ("e", "in", "innen", ""), "er": ("erin", "erinnen", "ern"), "s": ("",)},
    "es": {"os": ("o", "a", "as"), "es": ("", "a", "as"), "as": ("a",), "s": ("",)},
    "fr": {"s": ("", "e", "es"), "ns": ("n", "nne", "nnes"), "fs": ("f", "ve", "ves")},
}


def _inflected() -> dict[str, str]:
    """Other forms of the terms and the term that stands for them; terms stand for themselves."""
    forms = {"woman": "women", "man": "men", "jew": "jewish", "jews": "jewish", "latina": "latino", "latinas": "latino", "turk": "turkish",
             "turks": "turkish", "teenager": "teenage", "teenagers": "teenage", "frau": "frauen", "mann": "männer", "junge": "jungen",
             "jude": "juden", "jüdin": "juden", "jüdinnen": "juden", "mujer": "mujeres", "alemán": "alemanes", "musulmán": "musulmanes"}
    for language, groups in IDENTITY_TERMS.items():
        for term in (t for group in groups for t in group):
            for own, others in ENDINGS[language].items():
                if term.endswith(own):
                    forms |= {f: term for x in others if len(f := term[: len(term) - len(own)] + x) > 2 and f not in forms}
    return {w: t for w, t in forms.items() if w not in TERMS}


INFLECTED = _inflected()
#: Stems that would stand for a term; no word has them.
TERM_STEMS = {t[:5] for t in [*TERMS, *INFLECTED] if len(t) >= 5}


@dataclass(frozen=True)
class ToxicityConfig:
    """``train_rows`` bounds the labelled rows used; the model has the ``max_features`` words that tell most.

    ``mentions`` neutral sentences are added to each labelled row as counterfactual rows.
    """

    train_rows: int = 20_000
    max_features: int = 2048
    min_documents: int = 4
    min_z: float = 4.0
    swap_weight: float = 1.0
    mentions: int = 2
    seed: int = 17
    l2: float = 1e-3
    steps: int = 300
    rate: float = 0.1
    threshold: float = 0.3


@dataclass
class ToxicityModel:
    words: dict[str, int]
    weights: np.ndarray
    bias: float
    swaps: int = 0
    mentions: int = 0

    def score(self, words: set[str]) -> float:
        total = self.bias + sum(self.weights[self.words[w]] for w in words & self.words.keys())
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def words_of(text: str | None) -> set[str]:
    """The distinct words of the whole text, and the five-letter stems of longer ones.

    Inflected identity terms count as the term, and no stem stands for one, so that a swap of
    terms changes all that names a group.
    """
    words = {INFLECTED.get(w, w) for w in WORD.findall((text or "").lower())}
    return words | {f"{w[:5]}-" for w in words if len(w) > 5 and w[:5] not in TERM_STEMS}


def train(rows: list[tuple[int, list[int]]], words: list[str], config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Logistic regression on word presence with a penalty on changed scores.

    ``rows`` are (label, indices into ``words``). Counterfactual rows are a labelled row that mentions an identity term
    with the term swapped, and any labelled row with a neutral sentence about a group of any language beside it;
    the squared change of score against the row itself is penalised, so weight can't rest on which group
    is named, nor on a mention. Full-batch Adam, deterministic.
    """
    index = {w: i for i, w in enumerate(words)}
    if not rows:
        return ToxicityModel(index, np.zeros(len(words)), -10.0)
    x = np.zeros((len(rows), len(words)), np.float32)
    y = np.array([label for label, _ in rows], np.float32)
    for i, (_, own) in enumerate(rows):
        x[i, own] = 1
    # each counterfactual: its row, and the features it has less or more
    changed: list[tuple[int, list[tuple[int, float]]]] = [
        (i, [(index[a], -1.0), (index[b], 1.0)])
        for group in GROUPS
        for a in group
        if a in index
        for i in np.flatnonzero(x[:, index[a]]).tolist()
        for b in group
        if b in index and not x[i, index[b]]
    ]
    swaps = len(changed)
    rng = np.random.default_rng(config.seed)
    frames = [(frame, term) for language, groups in IDENTITY_TERMS.items() for group in groups for term in group for frame in MENTIONS[language]]
    told = [[index[w] for w in sorted(words_of(frame.format(term))) if w in index] for frame, term in frames]
    for i in range(len(rows)):
        for k in rng.integers(len(frames), size=config.mentions):
            if new := [(j, 1.0) for j in told[k] if not x[i, j]]:
                changed.append((i, new))
    at = np.array([i for i, _ in changed], np.int64)
    of = np.array([c for c, (_, d) in enumerate(changed) for _ in d], np.int64)
    feature, sign = (np.array([e[k] for _, d in changed for e in d], kind) for k, kind in ((0, np.int64), (1, np.float64)))
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, bias = np.zeros(len(words), np.float32), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, config.steps + 1):
        z = x @ w + bias
        p = sigmoid(z)
        r = (p - y) / len(y)
        g = np.append(x.T @ r + config.l2 * w / len(y) * 100, r.sum())
        if changed:
            q = sigmoid(z[at] + np.bincount(of, sign * w[feature], len(at)))
            gap = 2 * config.swap_weight * (q - p[at]) / len(at)
            dq, dp = gap * q * (1 - q), gap * p[at] * (1 - p[at])
            g[:-1] += np.bincount(feature, sign * dq[of], len(w))
            shift = np.bincount(at, dq - dp, len(y)).astype(np.float32)
            g[:-1] += x.T @ shift
            g[-1] += shift.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = config.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1].astype(np.float32)
        bias -= float(move[-1])
    return ToxicityModel(index, w.astype(np.float64), bias, swaps, len(changed) - swaps)


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), folds: int = 4, out: int = 2) -> ToxicityModel:
    """Learn from ``labels(doc_id, toxic)`` outside fold ``out``.

    The sample is the ``train_rows`` ids first by hash; only they are broadcast. Words are
    chosen by document frequencies, counted by Spark over the whole texts of the sample;
    the driver gets the chosen words and, by row, their indices. Words that tell as much are taken in
    order. No labelled row, or an empty table, gives a model that scores every text near 0.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & (fold("doc_id", folds) != out))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(config.train_rows)
    )
    sample = docs.join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), F.col("text").cast("string"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch["toxic"].to_pylist(), batch["text"]):
                words = sorted(words_of(text.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * (len(words) + 1), pa.int32()), pa.array(["", *words], pa.string())], ["toxic", "word"]
                )

    counts = sample.mapInArrow(split, "toxic int, word string").groupBy("word").agg(
        F.sum(F.col("toxic").cast("long")).alias("n1"), F.count("*").alias("n")
    )
    totals = sample.agg(F.sum(F.col("toxic").cast("long")).alias("n1"), F.count("*").alias("n")).first()
    if not totals["n"]:
        return train([], [], config)
    n1, n = float(totals["n1"]), float(totals["n"])
    n0 = max(n - n1, 1.0)
    share = (F.col("n") / F.lit(n)).alias("share")
    gap = F.col("n1") / F.lit(max(n1, 1.0)) - (F.col("n") - F.col("n1")) / F.lit(n0)
    z = gap / F.sqrt(share * (1 - share) * (1 / F.lit(max(n1, 1.0)) + 1 / F.lit(n0)) + F.lit(1e-12))
    terms = sorted(TERMS)
    kept = (
        counts.where((F.col("n") >= config.min_documents) & (F.col("word") != ""))
        .withColumn("z", z)
        .where((F.abs("z") >= config.min_z) & ~F.col("word").isin(terms))
        .orderBy(F.desc(F.abs("z")), "word")
        .limit(config.max_features - len(terms))
    )
    words = terms + sorted(r["word"] for r in kept.select("word").collect())
    index = {w: i for i, w in enumerate(words)}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(index[w] for w in words_of(t.as_py()) & index.keys()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(own, pa.list_(pa.int32()))], ["doc_id", "toxic", "own"])

    rows = sample.mapInArrow(look_up, "doc_id long, toxic int, own array<int>").orderBy("doc_id", F.xxhash64("own")).limit(config.train_rows).collect()
    return train([(r["toxic"], r["own"]) for r in rows], words, config)


def score_toxicity(docs: DataFrame, model: ToxicityModel, config: ToxicityConfig = ToxicityConfig(), folds: int = 4, out: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts get the score of a text without known words. A null ``doc_id`` is
    not held out by its fold, which is null, and is never learned from. Repeated rows each return, equal texts
    with equal scores; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    threshold = config.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(words_of(t.as_py())) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held = F.coalesce(fold("doc_id", folds) == out, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity_model(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model)
