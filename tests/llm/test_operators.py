"""The operators on small tables: brute force, and the cases their docstrings define."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from ledgerlens.llm import bpe, graph, hosts, language, lines, mih, queries, secrets, sharding, simhash, templates, toxicity
from ledgerlens.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, shard int, n string"


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def frame(spark, rows):
    """Documents with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "h", 1, "n") for i, t, la, s in rows], SCHEMA)


LINE = "This is a long line that many documents have in common, really."


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"  {LINE.upper()} \nown line {i}", "en", "src0") for i in range(6)]
    rows += [(6, None, None, None), (7, "", "en", None), (None, LINE, "en", "src1"), (7, "", "en", None), (8, "\n\n", "fr", "src2")]
    rows += [(9, "word " * 30_000, "en", "src2"), (10, "a b", "de", "src2"), (2, "another text under one id", "en", "src9")]
    return frame(spark, rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def test_line_dedup_cases(spark, odd):
    out = lines.dedup_lines(odd).toPandas()
    assert len(out) == odd.count()
    kept = {(r.doc_id, r.n_dropped) for r in out.itertuples() if r.kept.startswith("own")}
    assert kept == {(float(i), 1) for i in range(5)}
    five = out[out.doc_id == 5].iloc[0]
    assert five.n_dropped == 0 and five.kept == f"  {LINE.upper()} \nown line 5"
    none = out[out.doc_id.isna()].iloc[0]
    assert (none.kept, none.n_lines, none.n_dropped) == ("", 1, 1)
    assert set(out[out.doc_id.isin([6, 7])].n_lines) == {1} and out[out.doc_id == 8].iloc[0].n_lines == 3
    whole = lines.without_shared_lines(odd)
    assert whole.columns == odd.columns and whole.count() == odd.count()
    texts = {r.doc_id: r for r in whole.collect() if r.doc_id in (0, 6)}
    assert texts[0].text == "own line 0" and texts[0].n_chars == 10 and texts[6].text is None


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    codes = spark.createDataFrame([], "id long, code long")
    outs = [
        lines.dedup_lines(none),
        bpe.encode_texts(none, queries.vocabulary_path()),
        secrets.scan_secrets(none),
        simhash.near_duplicates(none),
        sharding.shard_documents(none),
        hosts.judge_pages(pages, queries.RULES),
        templates.find_contaminated(none, bench),
        toxicity.score_toxicity(none, toxicity.fit(none, labels)),
        language.identify(none, language.fit(none)),
        mih.top_k(codes, codes),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)
    assert templates.find_contaminated(odd, bench).count() == 0


def test_bpe_cases(spark, odd):
    out = bpe.encode_texts(odd, queries.vocabulary_path()).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == odd.count()
    for r in out:
        assert (r.n_tokens == 0) == (r.decoded == "") and len(r.ids) == r.n_tokens
        if not r.n_tokens:
            assert r.ids_sha256 == r.decoded_sha256 == empty


def test_shards(spark, odd):
    docs = odd.unionByName(frame(spark, [(100 + i, f"text {i % 40} " * (1 + i % 7), "en", "s") for i in range(400)]))
    out = sharding.shard_documents(docs, shards=8).toPandas()
    assert len(out) == docs.count() and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = docs.toPandas()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts.text)
    assert sorted(zip(out["size"], out.text_crc32)) == want
    assert (out.groupby(["size", "text_crc32"]).shard.nunique() == 1).all()
    even = sharding.shard_documents(frame(spark, [(i, "x" * (i % 97), "en", "s") for i in range(2000)]), 8).toPandas()
    loads = even.groupby("shard")["size"].sum()
    groups = even.groupby("text_crc32")["size"].sum().sort_values(ascending=False)
    plan = [0] * 8
    for size in groups:
        plan[plan.index(min(plan))] += size
    assert sorted(loads) == sorted(plan)


def _classes(fps, radius):
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def test_simhash_equals_all_pairs(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10_000))
    local = docs.toPandas()
    local["fp"] = [simhash.fingerprint(t or "") & (2**64 - 1) for t in local.text]
    roots = _classes(sorted(set(local.fp)), 3)
    local["root"] = local.fp.map(roots)
    least = local.groupby("root").doc_id.min()
    want = sorted((str(r.doc_id), f"{r.fp:016x}", str(least[r.root])) for r in local.itertuples())
    for rows in (4096, 2):  # larger shards are split until two rows are left
        got = simhash.near_duplicates(docs, shard_rows=rows).drop("text_hash").toPandas()
        assert sorted((str(a), b, str(c)) for a, b, c in got.itertuples(index=False)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == set(least.dropna().astype(int))


def test_components(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: r for x, r in label.items() if x != r}


def test_top_k_cases(spark):
    rng = random.Random(1)
    rows = [(i, rng.getrandbits(63) if i % 3 else 5) for i in range(300)] + [(None, 3), (1000, None), (7, 5)]
    base = spark.createDataFrame(rows, "id long, code long")
    got = mih.top_k(base, base.where("id % 50 = 0"), k=5).toPandas()
    known = [(i, c) for i, c in rows if i is not None and c is not None]
    for q, c in known:
        if q % 50 == 0:
            best = sorted(((c ^ d).bit_count(), i) for i, d in known)[:5]
            mine = got[got.query_id == q].sort_values("rank")
            assert list(zip(mine.distance, mine.id)) == best
    few = spark.createDataFrame([(1, 9), (2, 8)], "id long, code long")
    assert mih.top_k(few, few, k=5).count() == 4


def test_secrets_ownership(spark):
    live, copied = "Zq8xK2mN7vB4tR6yW1pL", "Aj3kD9fG5hS7qE2rT8uX"
    rows = [(1, f"see {live} here", "en", "a"), (2, f"see {live} again password=hunter22", "en", "a")]
    rows += [(3, f"x {copied}", "en", "a"), (4, f"é {copied}", "en", "b"), (5, None, None, None), (6, "", "en", "b"), (6, "", "en", "b")]
    out = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert out[1].spans == "owner:4:24" and out[2].spans == "owner:4:24,assign:31:48"
    assert out[3].spans == out[4].spans == "" and out[3].n_copied == 1 and out[2].n_live == 2
    assert out[2].base_sha256 == hashlib.sha256(b"assign:31:48").hexdigest()
    assert out[5].spans == "" and out[5].n_assign == 0


def test_secrets_by_repositories_and_owners(spark):
    live, spread = "Zq8xK2mN7vB4tR6yW1pL", "Aj3kD9fG5hS7qE2rT8uX"
    rows = [(1, f"see {live} here", "en", "a"), (2, f"see {live} here", "en", "b")]  # one document and its copy
    rows += [(10 + i, f"text {i} {spread}", "en", "a") for i in range(secrets.MANY_REPOS + 1)]
    out = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert out[1].spans == out[2].spans == "owner:4:24" and out[1].n_live == 1 and out[1].ownership == "owner:4:24:1:2"
    assert out[10].spans == "" and out[10].n_copied == 1 and out[10].ownership == f"owner:7:27:{secrets.MANY_REPOS + 1}:1"


def test_hosts_rules_and_graph(spark):
    rows = [
        (1, "https://WWW.Example.com/en/x?y", ""), (2, "http://a.example.com/en/", ""), (3, "http://a.example.com/fr", ""),
        (4, "http://bad.net/es/1", '<a href="http://other.org/z">'), (5, "http://bad.net/de/1", ""), (6, "http://friend.org/1", "<a href='//bad.net/q'>"),
        (7, "http://calm.org/1", '<a href="/x">'), (8, None, None), (9, "no scheme", ""), (10, "http://example.com", ""), (7, "http://calm.org/1", None),
    ]
    out = hosts.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(rows)
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("com/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5][2:] == (None, "block") and got[6][2:] == (None, "block")
    assert got[7] == ("calm.org", "/1", None, "allow") and got[8] == got[9] == ("", "", None, "allow")
    assert got[10][1:] == ("", None, "allow") or got[10][1:] == ("", None, "block")


def solved(edges, seeds, damping=0.85):
    """Personalised PageRank as the solution of a linear system, scaled to one."""
    names = sorted({h for s, d, _ in edges for h in (s, d)} | set(seeds))
    at = {h: i for i, h in enumerate(names)}
    move = np.zeros((len(names), len(names)))
    for s, d, w in edges:
        move[at[d], at[s]] += w
    out = move.sum(axis=0)
    move /= np.where(out > 0, out, 1)
    seed = np.zeros(len(names))
    for h, m in seeds.items():
        seed[at[h]] = m / sum(seeds.values())
    x = np.linalg.solve(np.eye(len(names)) - damping * move, (1 - damping) * seed)
    return dict(zip(names, x / x.sum()))


def test_spread_is_pagerank(spark):
    rng = random.Random(1)
    small = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "d", 1.0), ("c", "c", 5.0)]
    chain = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(12)]
    drawn = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}"): float(rng.randint(1, 5)) for _ in range(200)}
    for edges, seeds in (
        (small, {"a": 2.0, "b": 1.0}),
        (chain, {"h0": 1.0}),
        ([(s, d, w) for (s, d), w in drawn.items()], {"n1": 1.0, "n2": 2.0, "lone": 1.0}),
    ):
        got = hosts.spread(
            spark.createDataFrame(edges, "src string, dst string, weight double"),
            spark.createDataFrame(list(seeds.items()), "host string, mass double"),
        )
        got = {r.host: r.score for r in got.collect()}
        want = solved(edges, seeds)
        assert all(abs(got.get(h, 0.0) - v) < 1e-6 for h, v in want.items()) and set(got) <= set(want)


def test_distrust_reaches_far_hosts_and_fades(spark):
    rows = [(i, f"http://h{i}.net/de/", f"<a href='http://h{i - 1}.net/de/'>") for i in range(1, 13)]
    rows += [(0, "http://h0.net/es/", "")]
    out = hosts.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.RULES, threshold=0.0)
    got = {r.page_id: (r.verdict, r.distrust) for r in out.collect()}
    assert all(v == "block" for v, _ in got.values())
    assert all(got[i][1] > got[i + 1][1] for i in range(1, 11))


def test_templates(spark):
    item = "A train leaves the old station at 9 hours and travels 120 km to meet Alice before noon, how fast does it go?"
    texts = {
        1: item,
        2: "intro words here. " + item.replace("9", "7").replace("120", "340").replace("Alice", "Bruno") + " more of it",
        3: item.replace("9 hours", "7 minutes") + " " + "Nothing else to see in this text at all.",
        4: "A train leaves. Nothing else to see here, and travels far to meet nobody before noon.",
        5: None, 6: "", 7: "short",
    }
    docs = frame(spark, [(i, t, "en", "s") for i, t in texts.items()] + [(1, item, "en", "s")])
    bench = spark.createDataFrame([(5, item, "x"), (6, None, "x"), (7, "two words", "x"), (8, item, "x")], "item_id long, text string, doc_id string")
    out = {r.doc_id: r for r in templates.find_contaminated(docs, bench).collect()}
    assert set(out) == {1, 2, 3} and out[1]["items"] == [5, 8]
    assert not out[1].changed and out[2].changed
    rest = templates.decontaminate(docs, bench)
    assert rest.columns == docs.columns and sorted(r.doc_id for r in rest.collect()) == [4, 5, 6, 7]
    # one value of the item meets two of the text: the slots do not agree
    twice = spark.createDataFrame([(1, "red 5 green 5 blue 5 black 5 white 5 grey 5 pink 5 brown")], "item_id long, text string")
    mixed = frame(spark, [(1, "red 1 green 2 blue 3 black 4 white 5 grey 6 pink 7 brown", "en", "s"), (2, "red 8 green 8 blue 8 black 8 white 8 grey 8 pink 8 brown", "en", "s")])
    assert [r.doc_id for r in templates.find_contaminated(mixed, twice).collect()] == [2]


def test_templates_in_any_capitals(spark):
    items = {
        1: "What is the capital city of France today?",
        2: "When did the Roman general Julius Caesar first cross the Rubicon river with his Legion?",
        3: "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May, how many did she sell altogether?",
        4: "Tom has 5 apples. Mary gives him 3 more. Tom eats 2 of the apples. How many apples does Tom have now?",
        5: "The Old Man And The Sea Was Written By Which Famous Author",
    }
    texts = {
        1: "intro " + items[1], 2: "so " + items[2].lower(), 3: items[3].replace("Natalia", "Robert").replace("48", "36"),
        4: "(a)  " + items[4].replace("Tom", "Ben").replace("Mary", "Zoe").replace("5", "8").replace("2", "4"), 5: items[5],
        6: items[1].upper(), 7: "x " + items[3].lower().replace("48", "36"), 8: "Which is the smallest village of Spain now? When did the Greek general sleep?",
        9: items[4].replace("Tom has", "Ben has").replace("Tom eats", "Max eats").replace("Tom have", "Leo have").replace("apples", "pears"),
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    out = {r.doc_id: r for r in templates.find_contaminated(frame(spark, [(i, t, "en", "s") for i, t in texts.items()]), bench).collect()}
    assert {i: r["items"] for i, r in out.items()} == {1: [1], 2: [2], 3: [3], 4: [4], 5: [5], 6: [1], 7: [3]}
    assert {i: r.changed for i, r in out.items()} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True}


def test_planted_benchmark_items(spark):
    root = "/root/testdata/sf0.01"
    got = {r.doc_id for r in queries.QUERIES["op1_template_decontamination"](spark, root).collect()}
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{root}/documents.parquet'").fetchall()
    items = [t for _, t in con.execute(f"SELECT item_id, text FROM '{root}/benchmark.parquet'").fetchall()]
    assert got == {i for i, t in docs if any(x in t for x in items)}


def test_toxicity_held_out(spark):
    root = "/root/testdata/sf0.1"
    out = queries.QUERIES["op7_toxicity_viterbi"](spark, root).toPandas()
    labels = pd.read_parquet(f"{root}/labels.parquet")
    both = out.merge(labels, on="doc_id")
    held = both[both.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert len(out) == 10_000 and hit / held.toxic.sum() > 0.85 and hit / held.predicted.sum() > 0.9
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]).all()
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_toxicity_cases(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(12)] + [(3, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    out = toxicity.score_toxicity(odd, toxicity.fit(odd, labels), keep=True).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.keep_clean(odd, toxicity.fit(odd, labels)).columns == odd.columns


def test_language_held_out(spark, odd):
    root = "/root/testdata/sf0.01"
    out = queries.QUERIES["op10_language_ftrl"](spark, root).toPandas()
    both = out.merge(pd.read_parquet(f"{root}/documents.parquet"), on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and both.score.between(0, 1).all()
    model = language.fit(odd)
    said = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert (6, "und") in said and (7, "und") in said and (8, "und") in said
