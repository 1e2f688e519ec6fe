"""Pure parts of the operators against brute force."""

import heapq
import random
import time

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, language, letters, secrets, sharding, simhash, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Vocabulary.read(PATH))


def test_bpe_equals_the_library(codec):
    lib = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    signs = list("aaabbcde  \n\t'sSt0123.,!é中  \x85\x1c​") + ["<|endoftext|>", "'ll", " the", "ing", " a"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 3000, "ab" * 2000, " " * 500, " \n" * 300, "0" * 700]
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert list(memoryview(got).cast("I")) == want
        assert codec.decode(got) == lib.decode(want, skip_special_tokens=False) == text


def test_automaton_accepts_one_path(codec):
    auto, rng = codec.auto, random.Random(2)
    for _ in range(200):
        word = bytes(rng.choice(b"theringons") for _ in range(rng.randint(1, 7)))
        paths = [([], 0)]
        accepted = []
        while paths:
            path, at = paths.pop()
            if at == len(word):
                accepted.append(path)
            for end in range(at + 1, len(word) + 1):
                token = auto.ids.get(word[at:end])
                if token is not None and (not path or auto.has_arc(path[-1], token)):
                    paths.append(([*path, token], end))
        assert accepted == [auto.encode_word(word)]


def _slow_fingerprint(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()
    words = [w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("text", ["", " \n", "One", "one Two", "Één ÀB c d e", "a b c " * 400, "x\x0by\x0cz\rw"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _slow_fingerprint(text, 3)


def test_forest_equals_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(20)]))
    values = rng.permutation(values)
    shard = np.sort(rng.integers(0, 3, len(values)))
    got = simhash.Forest(values, shard).classes(3)
    want = np.arange(len(values))
    near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 3) & (shard[:, None] == shard[None, :])
    for _ in range(len(values)):
        new = np.where(near, want[None, :], len(values)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (got == want).all()


def test_masks_are_certain():
    rng = random.Random(1)
    for _ in range(500):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not bits & m for m in simhash._masks(3))
        first = next(m for m in simhash._masks(3) if not bits & m)
        assert any(not bits & m for m in simhash._finer(first, 3))


def test_deal_is_the_heap():
    rng = random.Random(3)
    for _ in range(50):
        sizes = sorted({rng.randint(1, 400): rng.randint(1, 300) for _ in range(30)}.items(), reverse=True)
        loads = [rng.randint(0, 500) for _ in range(8)]
        heap = [(x, k) for k, x in enumerate(loads)]
        heapq.heapify(heap)
        for size, count in sizes:
            for _ in range(count):
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
        want = sorted(x for x, _ in heap)
        plan = sharding.deal(sizes, loads)
        assert sorted(loads) == want
        assert all(sum(plan[s]) == n for s, n in sizes)


def test_secret_patterns():
    text = 'x TOKEN: "abc123" api_key=abcde PassWord= hunter2 AKIA' + "A" * 16 + " AKIAB " + "0a" * 12 + " ſecret=abcdef"
    named = [(secrets.KINDS[k], text[s:e]) for s, k, e, _ in secrets.base_spans(text)]
    assert named == [
        ("assign", 'TOKEN: "abc123'),
        ("assign", "PassWord= hunter2"),
        ("access", "AKIA" + "A" * 16),
        ("hex", "0a" * 12),
    ]


def test_restoring():
    counts = np.bincount(letters.ngrams(letters.symbols("  you are an idiot and a moron  stupid scum loser  " * 50), 3), minlength=64**3)
    restorer = toxicity.Restorer(toxicity.LetterModel.of(counts))
    assert restorer("You 1d10t, m0r0n! i d i o t, and s.c.u.m $tupid looooser") == "you idiot, moron! idiot, and scum stupid loser"
    assert restorer("") == ""
    for text in ("plain words", "a$$$ b!! 5", "x" * 2000, "a b c d " * 50):
        low = text.lower()
        assert restorer(text) == toxicity.ODD.sub(restorer._one, low)


FORMS = {
    "a sign at the end": ("idio7 loser$ a$$", "idiot losers ass"),
    "signs within": ("scu/m tras# stu.pid mo-ron", "scum trash stupid moron"),
    "signs within and at the end": ("tr@s4 7ra$#", "trasa trash"),
    "signs in spaced letters": ("i d 1 o t, m 0 r 0 n; s.t.u.p.1.d", "idiot, moron; stupid"),
    "wide spacing": ("s  t  u  p  i  d, m -- o -- r -- o -- n", "stupid, moron"),
    "doubled letters": ("stuupid morron iddiot", "stupid moron idiot"),
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_each_form_is_restored(form):
    sample = "  you are an idiot and a moron  stupid scum losers  ass trash trasa  all good books and/or hello 7 of the  "
    restorer = toxicity.Restorer(toxicity.LetterModel.of(np.bincount(letters.ngrams(letters.symbols(sample * 50), 3), minlength=64**3)))
    given, want = FORMS[form]
    assert restorer(given) == want
    assert restorer("text before " * 20 + given + " then 1 2 3 all good books and/or hello!") == "text before " * 20 + want + " then 1 2 3 all good books and/or hello!"
    rng = random.Random(6)
    for _ in range(300):  # finding stretches first changes nothing
        text = "".join(rng.choice(list("aabs  .1$!5/-#") + ["  ", " x ", "word "]) for _ in range(60))
        assert restorer(text) == toxicity.ODD.sub(restorer._one, text)


def test_viterbi_is_the_best_reading():
    rng = np.random.default_rng(4)
    model = toxicity.LetterModel.of(rng.integers(0, 50, 64**3))

    def cost(reading, extra):
        x = y = 0
        for c in reading + " ":
            z = int(letters.TABLE[ord(c)])
            extra -= float(model.table[x, y, z])
            x, y = y, z
        return extra

    for token in ("1d1ot", "l1|e", "aaab", "a b c", "$o+0"):
        readings = [("", 0.0)]
        for options in toxicity.lattice(token):
            readings = [(r + o, c + e) for r, c in readings for o, e in options]
        best = min(cost(r, c) for r, c in readings)
        got = toxicity.restore(token, model)
        assert min(cost(r, c) for r, c in readings if r == got) == pytest.approx(best)


def test_language_features_and_model():
    codes = language.features("Ab\U00020000 1")
    assert len(codes) and language.LanguageModel(("en",), np.ones(language.DIMS, np.float32), np.zeros((language.DIMS + 1, 1), np.float32), 1.0).predict("123 !") == ("und", 1.0)
    again = letters.once(codes.copy(), np.zeros(language.DIMS, np.int64))
    assert sorted(again) == sorted(set(codes.tolist()))


@pytest.mark.parametrize("unit", ["ab", "a", "7", "1a", "a b ", "a/", "word1x\n", "!", "a_1"])
def test_long_runs_take_time_in_proportion(unit):
    restorer = toxicity.Restorer(toxicity.LetterModel.of(np.ones(64**3, np.int64)))
    began = time.perf_counter()
    for n in (100_000, 25_000):
        text = unit * (n // len(unit)) + ",x1 b"
        assert restorer(text)[-2:] == " b"
    assert time.perf_counter() - began < 60  # many minutes if each start of a run were tried
