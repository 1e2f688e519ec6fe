"""Toxicity: undo obfuscated spelling by Viterbi decoding, then score the restored text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import crc_mod, map_texts
from ledgerlens.llm.letters import SYMBOLS, TABLE, code_points, letter_symbols, ngrams, symbols
from ledgerlens.sources.storage import cut_lineage

MAX_TRAIN = 20_000  # labelled rows the scorer is fitted on, chosen by hash
MAX_FEATURES = 20_000  # n-grams that may carry a weight
GRAM = 5
CACHE = 50_000  # restored tokens a worker keeps
LONG = 64  # letters of a token that is not kept
BATCH_BYTES = 1_000_000  # of text whose symbols and n-grams are held at once

# Letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "#": "h",
}
NOISE = "/\\*._~^-"  # signs that may have been put between the letters of a word
# costs of the channel, as negative logarithms
COST_LEET, COST_REPEAT, COST_KEPT = 0.5, 0.7, 4.0
COST_NOISE = 3.0  # a sign within a word left out
GAP = 4  # separators in a row between single letters
REACH = 3 * (GAP + 1)  # beyond the first of three spaced letters

# Tokens that the channel may have changed: spaced single letters or signs, words with signs in or
# beside them, words with two equal letters in a row. All but the first start where a run of letters
# or signs starts, so that a run which is no such token is read once and not from each of its letters.
_SIGN, _LETTER = "[0-9@$!|+#]", r"[^\W\d_]"
SEPARATORS = rf"[ {re.escape(NOISE)}]{{1,{GAP}}}"
_ONE = rf"(?:{_LETTER}|{_SIGN})"
ODD = re.compile(
    rf"(?<![^\W_]){_ONE}(?:{SEPARATORS}{_ONE}(?![^\W_]|[@$|+#])){{2,}}"
    rf"|(?<!{_LETTER})(?<!{_SIGN})(?:"
    rf"{_SIGN}*+{_LETTER}++(?:(?:{_SIGN}++|[{re.escape(NOISE)}]){_LETTER}++)++{_SIGN}*+"
    rf"|{_SIGN}++{_LETTER}++{_SIGN}*+|{_LETTER}++{_SIGN}++"
    rf"|{_LETTER}*({_LETTER})\1+{_LETTER}*)"
)
SPACED = re.compile(rf"{_ONE}(?:{SEPARATORS}{_ONE}){{2,}}")


@dataclass(frozen=True)
class LetterModel:
    """Log probability of a symbol after two others."""

    table: np.ndarray

    @cached_property
    def flat(self) -> list[float]:
        """The table as plain numbers, which are faster to read one by one."""
        return self.table.ravel().tolist()

    @staticmethod
    def of(counts: np.ndarray) -> LetterModel:
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        c2 = c3.sum(axis=0)
        p1 = (c2.sum(axis=0) + 1) / (c2.sum() + SYMBOLS)
        p2 = (c2 + 10 * p1) / (c2.sum(axis=1, keepdims=True) + 10)
        p3 = (c3 + 10 * p2) / (c3.sum(axis=2, keepdims=True) + 10)
        return LetterModel(np.log(p3).astype(np.float32))


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all whole texts. There are 64**3 of them at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            # two spaces between texts, so that no trigram has letters of two
            s = symbols("  ".join(t for t in batch.column(0).to_pylist() if t))
            counts += np.bincount(ngrams(s, 3), minlength=SYMBOLS**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])

    rows = map_texts(docs.select(F.col(text_col).alias("text")), work, "gram long, n long", BATCH_BYTES)
    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["gram"]] = r["n"]
    return counts


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each stretch of an odd token may have been: (letters, cost)."""
    spaced = SPACED.fullmatch(token) is not None
    gap = min(map(len, re.findall(SEPARATORS, token)), default=0) if spaced else 0  # a wider one may be a blank
    slots = []
    at = 0
    while at < len(token):
        c = token[at]
        n = 1
        while at + n < len(token) and token[at + n] == c:
            n += 1
        if c.isalpha():
            if n == 1:
                slots.append([(c, 0.0)])
            elif n == 2:
                slots.append([(c * 2, 0.0), (c, COST_KEPT)])  # most doubled letters are right
            else:
                slots.append([(c, COST_REPEAT), (c * 2, COST_REPEAT), (c * n, COST_KEPT)])
        elif c in LEET:
            read = [(x, COST_LEET) for x in LEET[c]] + [(c * n, COST_KEPT)]
            slots.append(read + [(x * 2, COST_LEET) for x in LEET[c] if n >= 2])
        elif spaced:
            while at + n < len(token) and not token[at + n].isalnum() and token[at + n] not in LEET:
                n += 1
            slots.append([("", 0.0), (" ", COST_KEPT if n <= gap else COST_REPEAT)])
        elif c in NOISE and n == 1:
            slots.append([(c, 0.0), ("", COST_NOISE)])
        else:
            slots.append([(c * n, 0.0)])
        at += n
    return slots


SYMBOL = TABLE.tolist()


Spelt = tuple["Spelt | None", str]  # what came before, and the letters added


def _spelling(end: Spelt | None) -> str:
    out = []
    while end is not None:
        end, letters = end
        out.append(letters)
    return "".join(reversed(out))


def restore(token: str, model: LetterModel) -> str:
    """The likeliest spelling: exact Viterbi over the lattice, with the last two symbols as state.
    Of equally likely ways the first one in the order of the lattice is taken. Linear in the length of
    the token."""
    logp = model.flat
    paths: dict[tuple[int, int], tuple[float, Spelt | None]] = {(0, 0): (0.0, None)}
    done: list[str] = []
    for options in [*lattice(token), [(" ", 0.0)]]:
        if len(paths) == 1:
            # all ways have met: what lies behind is settled
            (state, (_, end)), = paths.items()
            done.append(_spelling(end))
            paths = {state: (0.0, None)}
        reached: dict[tuple[int, int], tuple[float, Spelt | None]] = {}
        for (a, b), (cost, end) in paths.items():
            for letters, extra in options:
                x, y, total = a, b, cost + extra
                for c in letters:
                    z = SYMBOL[min(ord(c), 0xFFFF)]
                    total -= logp[(x * SYMBOLS + y) * SYMBOLS + z]
                    x, y = y, z
                known = reached.get((x, y))
                if known is None or total < known[0]:
                    reached[x, y] = (total, (end, letters))
        paths = reached
    return ("".join(done) + _spelling(min(paths.values(), key=lambda path: path[0])[1]))[:-1]


SIGN = np.zeros(0x10000, bool)
SIGN[[ord(c) for c in [*LEET, *"0123456789"]]] = True
INNER = np.zeros(0x10000, bool)
INNER[[ord(c) for c in NOISE]] = True


class Restorer:
    """Lower-case a text and restore its odd tokens; spellings once decoded are kept."""

    def __init__(self, model: LetterModel) -> None:
        self.model = model
        self.known: dict[str, str] = {}

    def _one(self, m: re.Match) -> str:
        token = m.group()
        if not any(c.isalpha() for c in token):
            return token  # numbers in a row
        if len(token) > LONG:
            return restore(token, self.model)
        if token not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = restore(token, self.model)
        return self.known[token]

    def __call__(self, text: str) -> str:
        low = text.lower()
        done, out = 0, []
        for start, end in odd_stretches(low):
            out += [low[done:start], ODD.sub(self._one, low[start:end])]
            done = end
        return "".join([*out, low[done:]]) if done else low


def odd_stretches(low: str) -> list[tuple[int, int]]:
    """Stretches between blanks that may hold an odd token. Few texts are all odd, so that finding
    them in arrays spares most of the pattern matching."""
    codes = code_points(low)
    letter = letter_symbols(low, codes) > 0
    n = len(codes)
    if n < 2:
        return [(0, n)] if n else []
    small = np.minimum(codes, 0xFFFF)
    sign = SIGN[small]
    hit = np.zeros(n, bool)
    hit[:-1] = (sign[:-1] & letter[1:]) | (letter[:-1] & (sign[1:] | (codes[:-1] == codes[1:])))
    hit[:-2] |= letter[:-2] & INNER[small[1:-1]] & letter[2:]
    # a single letter or sign, then separators, then another
    one = letter | sign
    alone = one.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~(one & (codes != ord("!")))[1:]
    at = np.flatnonzero(alone)
    near = np.diff(at) <= GAP + 1
    hit[at[:-2][near[:-1] & near[1:]]] = True
    found: list[list[int]] = []
    blanks = np.flatnonzero((codes == ord(" ")) | (codes == ord("\n")))
    hits = np.flatnonzero(hit)
    # the blanks around each hit: the last before it, the first from REACH behind it
    before = np.concatenate([[-1], blanks])[np.searchsorted(blanks, hits)] + 1
    behind = np.concatenate([blanks, [n]])[np.searchsorted(blanks, np.minimum(hits + REACH, n))]
    for p, low_end, high_end in zip(hits.tolist(), before.tolist(), behind.tolist()):
        if found and p < found[-1][1]:
            if p + REACH > found[-1][1]:
                found[-1][1] = high_end
        else:
            found.append([low_end, high_end])
    return [(s, e) for s, e in found]


def word_grams(text: str) -> tuple[np.ndarray, int]:
    """N-grams of a text that lie in one word, with repeats, and the number of words. The ends of a
    word count as symbols."""
    s = np.concatenate([[0], symbols(text), [0]]).astype(np.uint8)
    codes = ngrams(s, GRAM)
    inner = np.ones(len(codes), bool)
    for i in range(1, GRAM - 1):
        inner &= s[i : len(codes) + i] > 0
    return codes[inner], int(((s[:-1] == 0) & (s[1:] > 0)).sum())


@dataclass(frozen=True)
class Scorer:
    """Weights of n-grams, and the line from their share and sum in a text to the log-odds."""

    model: LetterModel
    grams: np.ndarray
    weights: np.ndarray
    line: tuple[float, float, float]  # of share, of sum, constant

    def evidence(self, text: str, restorer: Restorer) -> tuple[float, float]:
        """Weights found for each hundred words, and altogether, as logarithms."""
        if not len(self.grams):
            return 0.0, 0.0
        codes, words = word_grams(restorer(text))
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        total = float(self.weights[at[self.grams[at] == codes]].sum())
        return math.log1p(100 * total / max(words, 1)), math.log1p(total)

    def probability(self, share: float, total: float) -> float:
        z = self.line[0] * share + self.line[1] * total + self.line[2]
        return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))


def _fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two numbers, by Newton's method with a slight pull to zero."""
    features = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    pull = np.full(3, 0.01)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (p - y) + pull * w
        hess = (features * (p * (1 - p))[:, None]).T @ features + np.diag(pull)
        w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return tuple(float(v) for v in w)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_train: int = MAX_TRAIN,
) -> Scorer:
    """Letter model from all texts; weights from at most about ``max_train`` labelled rows.

    Labels are read only where crc32 of the id modulo 5 is not 0. The training rows are those with
    the smallest hashes of their id. An n-gram gets a weight if toxic texts hold it more often than
    chance allows for the number of n-grams tested; its weight is its smoothed log-odds.

    The classifier is bounded: an n-gram in fewer than 4 toxic texts of the sample, where chance
    cannot be told from a sign, gets no weight; of the others the ``4 * MAX_FEATURES`` most frequent
    are tested, and the ``MAX_FEATURES`` that tell most are kept. Repeated labels of a document count
    as toxic if one does; labels other than 0 and 1, null ids and null texts teach nothing. Empty
    tables, or labels of one class, give a scorer without weights.
    """
    spark = docs.sparkSession
    model = LetterModel.of(letter_counts(docs, text_col))
    given = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & (crc_mod(F.col("id"), 5) != 0))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    count = given.count()
    if count > max_train:
        share = int((max_train / count) * (1 << 40))
        given = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # ids and labels of the sample: bounded by max_train
    sample = cut_lineage(texts.join(F.broadcast(given), "id").select("y", "text"))
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    nothing = Scorer(model, np.empty(0, np.int64), np.empty(0, np.float32), (0.0, 0.0, math.log((toxic + 0.5) / (clean + 0.5))))
    if not toxic or not clean:
        return nothing

    def counted(rows: DataFrame, only: np.ndarray | None) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(model)
            for batch in batches:
                each = [np.unique(word_grams(restorer(t or ""))[0]) for t in batch.column(1).to_pylist()]
                codes = np.concatenate([np.empty(0, np.int64), *each])
                if only is not None:
                    at = np.minimum(np.searchsorted(only, codes), len(only) - 1)
                    codes = codes[only[at] == codes]
                gram, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

        return map_texts(rows, work, "gram long, n long", BATCH_BYTES).groupBy("gram").agg(F.sum("n").alias("n"))

    in_toxic = cut_lineage(counted(sample.where("y = 1"), None).where("n >= 4"))
    tested = max(in_toxic.count(), 1)
    # the most frequent of them: a gram in few toxic texts cannot tell much
    frequent = in_toxic.orderBy(F.desc("n"), "gram").limit(4 * MAX_FEATURES).toPandas().sort_values("gram")
    grams, t = frequent["gram"].to_numpy(), frequent["n"].to_numpy().astype(float)
    if not len(grams):
        return nothing
    seen = counted(sample.where("y = 0"), grams).toPandas().set_index("gram")["n"]
    c = seen.reindex(grams).fillna(0).to_numpy().astype(float)
    p, n = toxic / (toxic + clean), t + c
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = t * np.log(t / (n * p)) + np.where(c > 0, c * np.log(np.maximum(c, 1e-9) / (n * (1 - p))), 0.0)
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    good = (t / n > p) & (surprise > math.log(tested) + 3) & (odds > 2)
    keep = np.sort(np.flatnonzero(good)[np.argsort(-surprise[good], kind="stable")][:MAX_FEATURES])
    scorer = Scorer(model, grams[keep], odds[keep].astype(np.float32), (0.0, 0.0, 0.0))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            x = np.array([scorer.evidence(t or "", restorer) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["y", "share", "total"])

    seen = map_texts(sample, summed, "y int, share double, total double", BATCH_BYTES).toPandas()
    line = _fit_line(seen[["share", "total"]].to_numpy(), seen["y"].to_numpy().astype(float))
    return Scorer(model, scorer.grams, scorer.weights, line)


def score_toxicity(
    docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: bool = False
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted`` and, if ``keep``, ``restored``.

    Tokens that may be obfuscated (signs in or beside a word, doubled letters, spaced letters and
    signs with up to ``GAP`` separators) are decoded in a lattice of leetspeak, spacing and repetition
    readings under the letter model; a token without any letter stays. The score of the restored text
    is a probability from 0 to 1.
    Nothing but the text enters it. ``held_out`` marks ids whose crc32 modulo 5 is 0.

    Null text counts as empty; an empty text gets the score of a text without any weighted n-gram.
    A null id is not held out. Without labels of both classes the score is the share of toxic ones
    (one half without any). Repeated rows score alike. An empty table gives an empty result.
    Nothing is shuffled; the scorer is bounded by its number of features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        restorer = Restorer(own.model)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            p = [own.probability(*own.evidence(t, restorer)) for t in texts]
            columns = [*batch.columns[:2], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if keep:
                columns, names = [*columns, pa.array([restorer(t) for t in texts], pa.string())], [*names, "restored"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(crc_mod(F.col(id_col), 5) == 0, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    schema = "doc_id long, held_out boolean, score double, predicted int" + (", restored string" if keep else "")
    return map_texts(rows, work, schema, BATCH_BYTES)


def keep_clean(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        restorer = Restorer(own.model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [own.probability(*own.evidence(t or "", restorer)) < 0.5 for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_texts(docs, work, docs.schema, BATCH_BYTES)
