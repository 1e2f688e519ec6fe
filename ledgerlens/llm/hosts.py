"""URL filters: listed rules first, then trust and distrust that spread over links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import lower_ascii
from ledgerlens.sources.storage import cut_lineage, scratch_path

MAX_RULES = 10_000  # rules are literals in the plan; a longer list belongs in a table
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
TOLERANCE = 1e-8  # mass still on its way when a rank counts as settled
LINKS_PER_PART = 4096  # hot hosts are split into parts of about this many edges


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (verdict, host/path) that fits, as a struct ``verdict, rule``; else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        name = name.lower()
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, weight``: links from host to host. A relative link stays on its host, and each
    host also links to the host one label above it (``www.a.b`` to ``a.b``, never to ``b``)."""
    url = F.col(url_col)
    rows = pages.select(host_of(url).alias("src"), F.regexp_extract_all(F.col(html_col), F.lit(HREF), 1).alias("links"))
    rows = rows.where("src <> ''")
    link = rows.select("src", F.explode("links").alias("link"))
    far = F.col("link").contains("://") | F.startswith("link", F.lit("//"))
    target = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    linked = link.select("src", F.when(far, host_of(target)).otherwise(F.col("src")).alias("dst"))
    above = F.regexp_extract("src", r"^[^.]+\.(.+\..+)$", 1)
    return (
        linked.unionByName(rows.select("src", above.alias("dst")))
        .where("dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, score``: personalised PageRank of the seeds (``host, mass``) along weighted edges.

    The rank is built up by what is still on its way: each round sends on only the mass that came
    in during the last one, until that is at most ``tolerance`` of the whole; what is missing then
    is below damping / (1 - damping)**2 times that. A link of a host to itself is solved at once
    (mass that comes in m times over, m = 1 / (1 - damping * its share)), so graphs in which most
    links stay on their host settle in few rounds; no number of rounds is fixed.

    Each round is one join of edges with the mass on its way and one partial aggregate; edges carry
    a part number, so that the edges of one host can lie in many tasks. What a host without edges
    holds returns to the seeds by the normalisation at the end.
    """
    total = seeds.agg(F.sum("mass")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score")).where(F.lit(False))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"), F.count("*").alias("degree"))
    shares = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share"), "degree")
    shares = cut_lineage(shares)
    own = shares.where("src = dst").groupBy("src").agg(F.sum("share").alias("share"))
    times = own.select(F.col("src").alias("h"), (1 / (1 - F.lit(damping) * F.col("share"))).alias("times"))
    factor = F.coalesce("times", F.lit(1.0))
    links = cut_lineage(
        shares.where("src <> dst")
        .join(times, F.col("dst") == F.col("h"), "left")
        .select(
            "src",
            "dst",
            (F.lit(damping) * F.col("share") * factor).alias("share"),
            F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / LINKS_PER_PART)).cast("int").alias("part"),
        )
    )
    parts = cut_lineage(links.groupBy("src").agg(F.max("part").alias("parts")))
    start = (F.lit(1 - damping) * F.col("mass") / F.lit(float(total)) * factor).alias("coming")
    state = seeds.join(times, F.col("host") == F.col("h"), "left").groupBy("host").agg(F.sum(start).alias("coming"))
    state = cut_lineage(state.select("host", F.col("coming").alias("score"), "coming"))
    while True:
        whole, coming = state.agg(F.sum("score"), F.sum("coming")).first()
        if coming <= tolerance * whole:
            return state.select("host", (F.col("score") / F.lit(float(whole))).alias("score"))
        sent = (
            state.where("coming > 0")
            .join(parts, F.col("host") == F.col("src"))
            .select("src", "coming", F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("part"))
            .join(links, ["src", "part"])
            .select(F.col("dst").alias("host"), F.lit(0.0).alias("score"), (F.col("coming") * F.col("share")).alias("coming"))
        )
        both = state.select("host", "score", F.lit(0.0).alias("coming")).unionByName(sent)
        state = both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("coming").alias("coming"))
        state = cut_lineage(state.select("host", (F.col("score") + F.col("coming")).alias("score"), "coming"))


def judge_pages(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = 1.0,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, trust, distrust``.

    A page that a rule fits gets its verdict (longest rule wins). Pages allowed or blocked by a
    rule make their hosts trusted or blocked seeds, in proportion. Trust spreads along links;
    distrust spreads against them, to hosts that link to blocked ones; see ``spread`` for when both
    are settled. A page without rule is
    blocked if the distrust of its host is over ``threshold`` times its trust plus the share of
    all pages it holds; any other is allowed.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed.
    Repeated rows are judged alike. An empty table gives an empty result. Other columns are not
    read. Only DataFrame functions are used; the graph holds one row per pair of hosts.
    """
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    hosts = cut_lineage(
        judged.groupBy("host").agg(
            F.count("*").cast("double").alias("pages"),
            F.count_if(F.col("fit.verdict") == "allow").cast("double").alias("allowed"),
            F.count_if(F.col("fit.verdict") == "block").cast("double").alias("blocked"),
        )
    )
    edges = cut_lineage(host_edges(pages, url_col, html_col))
    known = hosts.where("host <> ''")
    trust = spread(edges, known.where("allowed > 0").select("host", F.col("allowed").alias("mass")))
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = spread(against, known.where("blocked > 0").select("host", F.col("blocked").alias("mass")))
    total = hosts.agg(F.sum("pages")).first()[0] or 1.0
    scores = (
        hosts.join(trust.withColumnRenamed("score", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        .select(
            F.col("host").alias("h"),
            F.coalesce("trust", F.lit(0.0)).alias("trust"),
            F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
            (F.col("pages") / F.lit(float(total))).alias("share"),
        )
    )
    # Written, so that both sides of the last join are plain exchanges, which adaptive execution splits.
    path = scratch_path(pages.sparkSession, "hosts")
    scores.write.parquet(path)
    scores = pages.sparkSession.read.parquet(path)
    bad = (F.col("distrust") > 0) & (F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("share")))
    return (
        judged.join(scores, F.col("host") == F.col("h"), "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
            "trust",
            "distrust",
        )
    )
