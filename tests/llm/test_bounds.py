"""What a worker keeps does not follow the size of the texts."""

import hashlib

import pytest

from ledgerlens.llm import bpe, queries, templates


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def test_bpe_caches_stay_bounded_within_one_text(monkeypatch):
    vocabulary = bpe.Vocabulary.read(queries.vocabulary_path())
    text = " ".join(f"{'abcdefghij'[i % 10]}w{i}ing" for i in range(3_000)) + "\nand " + "q" * 500 + " once more"
    want = bpe.Codec(vocabulary).encode(text)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 200)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 100)
    monkeypatch.setattr(bpe, "CACHE_ARCS", 300)
    monkeypatch.setattr(bpe, "STEP", 50, raising=False)
    codec = bpe.Codec(vocabulary)
    for t in (text.replace("\n", " "), text):
        got = codec.encode(t)
        assert codec.decode(got) == t
        assert len(codec.pieces) <= 250 and len(codec.words) <= 100 and len(codec.auto.arcs) <= 300
        assert max(map(len, codec.words), default=0) < 500
    assert got == want


def test_token_ids_of_many_batches(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 300, raising=False)
    texts = [None, "", "a b", "word " * 200, "é中", "x"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in bpe.encode_texts(docs, queries.vocabulary_path()).collect():
        assert len(r.ids) == r.n_tokens and r.decoded == (texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest()


def test_shuffled_benchmark_windows_find_what_shipped_ones_find(spark, monkeypatch):
    bench = spark.createDataFrame(
        [(1, "Natalia sold 48 clips to her friends in April and half as many in May"), (2, "what is the capital city of France today")],
        "item_id long, text string",
    )
    docs = spark.createDataFrame(
        [(1, "intro. Robert sold 36 clips to her friends in April and half as many in May. " + "end " * 50), (2, "nothing"), (3, None),
         (4, "What is the capital city of France today?"), (4, "x " * 300)],
        "doc_id long, text string",
    )
    shipped = sorted(templates.find_contaminated(docs, bench).collect())
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", -1)
    found = templates.find_contaminated(docs, bench)
    assert sorted(found.collect()) == shipped and {r.doc_id for r in shipped} == {1, 4}
    # what is shuffled holds the words of a window
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line and "names" in line)
    below = plan[plan.index(join) :]
    assert "slice(marked" in below.splitlines()[1] or any("slice(marked" in x for x in below.splitlines()[:6])
