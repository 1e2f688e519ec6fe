"""Secret scans: pattern matches in each text, and ownership of every candidate across the corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import map_texts
from ledgerlens.sources.storage import cut_lineage

# The kinds, in the order in which spans that begin together are listed, and their patterns.
KINDS = ("assign", "access", "hex", "owner")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more: the same spans as all runs, short ones dropped
# Other strings that may be a credential: long, with letters and digits.
OTHER = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000|1234", re.I)

MAX_OWNERS, MAX_REPOS = 1, 1  # a value beyond both is copied
MANY_REPOS = 50  # a value of more repositories is copied, whoever owns them

SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())])


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``start, kind, end, value`` by start and kind; offsets in code points."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


def other_spans(text: str, base: list[tuple[int, int, int, str]], least_entropy: float) -> list[tuple[int, int, int, str]]:
    """Live-looking strings that touch no base span."""
    found = []
    for m in OTHER.finditer(text):
        if all(m.end() <= s or e <= m.start() for s, _, e, _ in base):
            value = m.group()
            if entropy(value) >= least_entropy and not PLACEHOLDER.search(value):
                found.append((m.start(), 3, m.end(), value))
    return found


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
    least_entropy: float = 3.2,
    max_repos: int = MAX_REPOS,
    many_repos: int = MANY_REPOS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, ownership``.

    Base spans are pattern matches and always stay. Every candidate value, base or not, is hashed
    (64 bits) and its distinct repositories and owners are counted over the whole corpus; equal texts
    count as one repository. A value is a copied example if it has more than ``max_owners`` owners
    and more than ``max_repos`` repositories, or more than ``many_repos`` repositories whoever owns
    them; any other is live. ``ownership`` lists repositories and owners of every candidate. A
    candidate outside the patterns becomes a span of kind ``owner`` if it is live and looks so
    (letters and digits, entropy, no placeholder word). ``spans`` lists all spans; ``n_live`` and
    ``n_copied`` count the candidates of the row by class.

    Texts are read once and never move; what moves are candidates. A value in a third of all rows
    is counted by partial aggregates.

    Null text counts as empty and has no span. A null owner counts as none; a value without any
    owner is live. Repeated rows are scanned alike. An empty table gives an empty result. Other
    columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, spans, copies = [[], [], []], [], [], []
            for text in batch.column(3).to_pylist():
                base = base_spans(text or "")
                copies.append(xxhash.xxh64_intdigest((text or "").encode()) - (1 << 63))
                for kind, n in enumerate(counts):
                    n.append(sum(k == kind for _, k, _, _ in base))
                named = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
                sums.append(hashlib.sha256(named.encode()).hexdigest())
                spans.append(
                    [
                        {"start": s, "kind": k, "end": e, "hash": xxhash.xxh64_intdigest(v.encode()) - (1 << 63)}
                        for s, k, e, v in base + other_spans(text or "", base, least_entropy)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(n, pa.int64()) for n in counts), pa.array(sums), pa.array(spans, pa.list_(SPAN)), pa.array(copies, pa.int64())],
                ["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found", "copy"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(text_col).alias("text"),
    )
    scanned = map_texts(
        rows,
        work,
        "doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "found array<struct<start:int,kind:int,end:int,hash:bigint>>, copy long",
    )
    # numbered before it is written, so that the number of a row stays what it is
    scanned = cut_lineage(scanned.withColumn("row", F.monotonically_increasing_id()))
    each = scanned.where(F.size("found") > 0).select("row", "repo", "owner", "copy", F.explode("found").alias("s"))
    each = each.select("row", "repo", "owner", "copy", "s", F.col("s.hash").alias("hash"))
    repo = F.coalesce("repo", F.concat(F.lit("text "), F.col("copy").cast("string")))
    ownership = each.groupBy("hash").agg(
        F.count_distinct("owner").alias("owners"), F.least(F.count_distinct(repo), F.count_distinct("copy")).alias("repos")
    )
    live = ((F.col("owners") <= max_owners) | (F.col("repos") <= max_repos)) & (F.col("repos") <= many_repos)
    judged = (
        each.select("row", "s", "hash")
        .join(ownership, "hash")
        .groupBy("row")
        .agg(
            F.collect_list(F.when((F.col("s.kind") < 3) | live, F.struct("s.start", "s.kind", "s.end"))).alias("kept"),
            F.collect_list(F.struct("s.start", "s.kind", "s.end", "repos", "owners")).alias("all"),
            F.count_if(live).alias("live"),
            F.count_if(~live).alias("copied"),
        )
    )
    kind = F.array(*(F.lit(k) for k in KINDS))
    shown = F.transform(
        F.array_sort("kept"),
        lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    counted = F.transform(
        F.array_sort("all"),
        lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), *(s[k].cast("string") for k in ("start", "end", "repos", "owners"))),
    )
    return scanned.join(judged, "row", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(F.array_join(shown, ","), F.lit("")).alias("spans"),
        F.coalesce("live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce(F.array_join(counted, ","), F.lit("")).alias("ownership"),
    )
