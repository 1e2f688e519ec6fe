"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import crc_mod, map_texts
from ledgerlens.llm.letters import SYMBOLS, ngrams, once, symbols
from ledgerlens.sources.storage import cut_lineage

PER_LANGUAGE = 500  # training rows of each language, about; chosen by hash
MAX_TRAIN = 20_000  # training rows altogether
DIMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
SCALE = 30.0  # features are mean TF-IDF times this


def features(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams that hold a letter, with repeats."""
    s = symbols(f" {text} ")
    one, two, three = ngrams(s, 1), ngrams(s, 2), ngrams(s, 3)
    return np.concatenate([one[one > 0], SYMBOLS + two[two > 0], SYMBOLS + SYMBOLS**2 + three[three > 0]])


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their values."""
    codes, n = np.unique(features(text), return_counts=True)
    return codes, (n / max(n.sum(), 1) * idf[codes] * SCALE).astype(np.float32)


def document_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each n-gram occurs, over all whole texts, and how many texts there are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last, n = np.zeros(DIMS, np.int64), np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[once(features(text or ""), last)] += 1
                n += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], ["gram", "n"]
        )

    rows = map_texts(docs.select(F.col(text_col).alias("text")), work, "gram long, n long")
    counts, total = np.zeros(DIMS, np.int64), 0
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["gram"] < 0:
            total = r["n"]
        else:
            counts[r["gram"]] = r["n"]
    return counts, total


@dataclass
class Ftrl:
    """Follow the regularised leader, per coordinate, with L1 and L2 penalties."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01

    def __post_init__(self) -> None:
        self.z = np.zeros((DIMS + 1, self.classes))
        self.n = np.zeros((DIMS + 1, self.classes))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
        self.n[at] = new


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # by n-gram and language; the last row is the constant
    temperature: float

    def logits(self, text: str) -> np.ndarray | None:
        """None if the text has no letter."""
        codes = features(text)
        if not len(codes) or not self.languages:
            return None
        # repeats add up to the term frequency
        return self.table[codes].mean(axis=0) * SCALE + self.weights[-1]

    @property
    def table(self) -> np.ndarray:
        if "_table" not in self.__dict__:
            object.__setattr__(self, "_table", (self.weights[:-1] * self.idf[:, None]).astype(np.float32))
        return self.__dict__["_table"]

    def predict(self, text: str | None) -> tuple[str, float]:
        v = self.logits(text) if text else None
        if v is None:
            return "und", 1.0
        p = _softmax(v.astype(np.float64) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    epochs: int = 4,
) -> LanguageModel:
    """Inverse document frequencies from all texts; weights from about ``per_language`` texts each.

    Learns only from rows with a language whose id has a crc32 modulo 4 other than 2. Of each
    language the rows with the smallest hashes of their id are taken. Four fifths of them train;
    the temperature that makes the rest likeliest is then kept.
    """
    counts, total = document_counts(docs, text_col)
    idf = (np.log((1 + total) / (1 + counts)) + 1).astype(np.float32)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (crc_mod(F.col("id"), 4) != 2))
    # one row for each language
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), idf, np.zeros((DIMS + 1, 0), np.float32), 1.0)
    each = min(per_language, MAX_TRAIN // len(languages) + 1)
    space = 1 << 40
    limit = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(space, int(each / sizes[lang] * space) + 1))))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(space))
    sample = cut_lineage(rows.withColumn("place", place).where(F.col("place") < F.element_at(limit, F.col("lang"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [weighted(t or "", shared.value) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a, _ in both], pa.list_(pa.int32())), pa.array([v for _, v in both], pa.list_(pa.float32()))],
                ["place", "lang", "at", "x"],
            )

    shared = docs.sparkSession.sparkContext.broadcast(idf)
    # bounded by MAX_TRAIN texts
    got = map_texts(sample.select("place", "lang", "text"), work, "place long, lang string, at array<int>, x array<float>")
    data = [
        (languages.index(r["lang"]), np.append(np.asarray(r["at"], np.int64), DIMS), np.append(np.asarray(r["x"], np.float32), 1.0))
        for r in sorted(got.toLocalIterator(), key=lambda r: (r["place"], r["lang"]))
    ]
    # the order must not follow the places, whose range differs by language
    order = np.random.default_rng(0).permutation(len(data))
    cut = max(1, len(data) * 4 // 5)
    train, rest = order[:cut], order[cut:]
    ftrl = Ftrl(len(languages))
    for _ in range(epochs):
        for i in train:
            y, at, x = data[i]
            ftrl.learn(at, x, y)
    w = ftrl.weights(slice(None))
    temperature = 1.0
    if len(rest):
        v = np.stack([data[i][2] @ w[data[i][1]] for i in rest])
        y = np.array([data[i][0] for i in rest])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
        loss = [-np.log(np.maximum(_softmax(v / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return LanguageModel(languages, idf, w.astype(np.float32), temperature)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    The whole text counts: its n-grams of one to three letters, with word boundaries. ``und``, with
    score 1, if the text is null or has no letter, or if no language was learned; else a learned
    language and its calibrated probability; ties go to the first in order. ``held_out`` marks ids
    whose crc32 modulo 4 is 2; a null id is not held out. Repeated rows are judged alike. An empty
    table gives an empty result. Nothing is shuffled; the model has a fixed number of dimensions.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([x for x, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(crc_mod(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    return map_texts(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")
