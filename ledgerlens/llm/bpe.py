"""BPE encoding and decoding by a tokenization automaton compiled from the merges.

The automaton reads tokens; it accepts a token sequence exactly when BPE would produce it. It
starts as one state with an arc for each byte. Each merge ``u v -> uv``, in rank order, adds one
gadget: the arcs labelled ``u`` are turned to a copy of their target that lacks the arc ``v``, and
every state that still has an arc ``u`` gets an arc ``uv`` to where ``v`` led. All arcs with one
label lead to the same state, so there is one state per token. It is kept as its history: the
state it was copied from and the arcs removed since, each with its rank. An arc ``t`` of a state is
there if no removal met it, nor any left part of ``t`` before ``t`` was made from it. Arcs that
encoding asks for are worked out once and kept in a transition table.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import map_texts

# The pre-split pattern of byte-level vocabularies. White_Space is spelled out, as
# the meaning of \s differs between regular expression engines.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHE_PIECES = 250_000  # pieces between single spaces whose ids a worker keeps
CACHE_WORDS = 100_000  # other words whose ids a worker keeps
CACHE_ARCS = 500_000  # arcs a worker keeps in its transition table
CACHE_LETTERS = 64  # a longer word is encoded each time
CACHE_TEXT = 6_000_000  # letters of all pieces kept
STEP = 20_000  # pieces of a text looked up together
BATCH_BYTES = 1_000_000  # of text whose ids are held at once
_NONE: dict[int, int] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """What a vocabulary file says: bytes by id, merges as id triples in rank order, special strings."""

    labels: tuple[bytes, ...]
    merges: tuple[tuple[int, int, int], ...]
    special: tuple[tuple[str, int], ...]
    name: str

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        spec = json.loads(raw)
        ids, letters = spec["model"]["vocab"], byte_letters()
        special = tuple((t["content"], t["id"]) for t in spec.get("added_tokens", ()))
        labels = [b""] * (1 + max([*ids.values(), *(i for _, i in special)]))
        for token, i in ids.items():
            labels[i] = bytes(letters[c] for c in token)
        for token, i in special:
            labels[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = tuple((ids[a], ids[b], ids[a + b]) for a, b in pairs)
        return Vocabulary(tuple(labels), merges, special, hashlib.sha256(raw.encode()).hexdigest())


@dataclass
class Automaton:
    """States by token, the arcs removed from each, and the table of arcs asked for so far."""

    vocabulary: Vocabulary
    arcs: dict[int, bool] = field(default_factory=dict)  # by state and token, in one number

    def __post_init__(self) -> None:
        v = self.vocabulary
        made = {token: (rank, left, right) for rank, (left, right, token) in enumerate(v.merges)}
        never = len(v.merges)
        # the gadget of each merge: state `left` loses its arc `right` at this rank
        self.removed: dict[int, dict[int, int]] = {}
        for rank, (left, right, _) in enumerate(v.merges):
            self.removed.setdefault(left, {}).setdefault(right, rank)
        # state `token` was copied, at the rank it was made, from the state of its right part
        self.copied = {token: (right, rank) for token, (rank, _, right) in made.items()}
        # arc `token` was made, at that rank, beside the arc of its left part
        self.beside = {token: (left, rank) for token, (rank, left, _) in made.items()}
        self.never = never
        self.ids = {label: i for i, label in enumerate(v.labels) if label and (i in made or len(label) == 1)}
        self.longest: dict[bytes, int] = {}  # by the first four bytes; other labels have three at most
        for label in self.ids:
            if len(label) > 3:
                self.longest[label[:4]] = max(self.longest.get(label[:4], 0), len(label))
        self.words = regex.compile(WORDS)
        self.split_special = regex.compile("|".join(regex.escape(s) for s, _ in sorted(v.special, key=lambda x: -len(x[0]))) or r"(?!)")
        self.special = dict(v.special)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state reached by one token has an arc labelled with another."""
        arc = state << 32 | token
        known = self.arcs.get(arc)
        if known is None:
            if len(self.arcs) >= CACHE_ARCS:
                self.arcs.clear()
            known = self.arcs[arc] = self._arc(state, token)
        return known

    def _arc(self, state: int, token: int) -> bool:
        until = self.never  # removals from the state count up to the copy that led on
        while True:
            removed = self.removed.get(state, _NONE)
            if removed:
                label, made = token, self.never
                while True:
                    rank = removed.get(label, self.never)
                    if rank < until and rank <= made and rank != self.never:
                        return False
                    if label not in self.beside:
                        break
                    label, made = self.beside[label]
            if state not in self.copied:
                return True
            state, until = self.copied[state]

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the accepted path that spells the word.

        From each state the longest arc is tried first; positions from which no path goes on are
        remembered, so that none is tried twice.
        """
        ids, n = self.ids, len(word)
        path: list[int] = []
        ends: list[int] = [0]
        dead: set[int] = set()
        size = min(n, self.longest.get(word[:4], 3))
        while ends[-1] < n:
            at = ends[-1]
            while size:
                token = ids.get(word[at : at + size])
                if token is not None and at + size not in dead and (not path or self.has_arc(path[-1], token)):
                    break
                size -= 1
            if size:
                path.append(token)
                ends.append(at + size)
                at += size
                size = min(n - at, self.longest.get(word[at : at + 4], 3))
            else:
                dead.add(at)
                path.pop()
                ends.pop()
                size = at - ends[-1] - 1
        return path


class Codec:
    """Encode whole texts with a bounded cache of pieces; decode ids by their labels."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.auto = Automaton(vocabulary)
        self.labels = vocabulary.labels
        self.pieces: dict[str, bytes] = {}
        self.letters = 0  # of the pieces
        self.words: dict[str, bytes] = {}

    def _new(self, word: str) -> bytes:
        """Ids of one word, as little-endian 32-bit integers."""
        path = self.auto.encode_word(word.encode())
        return struct.pack(f"<{len(path)}I", *path)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self._new(word)
            if len(word) <= CACHE_LETTERS:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        """Ids of a stretch without special strings."""
        return b"".join(map(self._word, self.auto.words.findall(text)))

    def _once(self, word: str) -> bytes:
        """Ids of a word that its piece keeps, so that it need not be kept twice."""
        return self.words.get(word) or self._new(word)

    def _learn(self, pieces: list[str]) -> bool:
        """Cache the ids of pieces that follow one space; False if a piece touches white space."""
        if len(self.pieces) > CACHE_PIECES or self.letters > CACHE_TEXT:
            self.pieces.clear()
            self.letters = 0
        for p in set(pieces).difference(self.pieces):
            if not p or p[0].isspace() or p[-1].isspace():
                return False
            # letters alone are one word, and so are a full stop or comma after them
            if p.isalpha():
                self.pieces[p] = self._once(" " + p)
            elif p[-1] in ".," and p[:-1].isalpha():
                self.pieces[p] = self._once(" " + p[:-1]) + self._word(p[-1])
            else:
                self.pieces[p] = self._ids(" " + p)
            self.letters += len(p)
        return True

    def _plain(self, text: str) -> bytes:
        # a single space between other characters always begins a word
        first, *rest = text.split(" ")
        if not rest:
            return self._ids(text)
        if not first or first[-1].isspace():
            return self._ids(text)
        out = [self._ids(first)]
        for at in range(0, len(rest), STEP):
            part = rest[at : at + STEP]
            if not self._learn(part):
                return self._ids(text)
            out.append(b"".join(map(self.pieces.__getitem__, part)))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not self.auto.special or not self.auto.split_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.auto.split_special.finditer(text):
            out += [self._plain(text[at : m.start()]), self.auto.special[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: Vocabulary) -> Codec:
    """One compiled automaton per worker process and vocabulary."""
    if vocabulary.name not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary.name] = Codec(vocabulary)
    return _CODECS[vocabulary.name]


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if
    ``keep``, ``ids`` (array of int) and ``decoded``.

    ``path`` names a byte-level BPE file with merges. Special strings in a text become their own
    id. The merges go to the workers once (their size is that of the file, not of the data); each
    worker compiles the automaton and maps its rows. Nothing is shuffled.

    Null text counts as empty; an empty text has no ids. Repeated rows are encoded alike. An empty
    table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            back = [own.decode(x) for x in ids]
            columns = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
            }
            if keep:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                columns["ids"] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<i4"))
                columns["decoded"] = pa.array(back, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(rows, work, schema + (", ids array<int>, decoded string" if keep else ""), BATCH_BYTES)
