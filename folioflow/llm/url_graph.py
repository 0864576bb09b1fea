"""URL filter: rules first, then trust and distrust spread over the host graph.

Rules name a host and a path prefix; of the rules that fit a url the longest decides. A host's seeds
are the shares of its pages that rules allow and block. Trust is personalised PageRank from the
allowed shares along the links between hosts, distrust the same walk from the blocked shares against
the links. Each has a companion from seeds of one for every host. What a host receives of a walk,
divided by what it receives of the companion, is its distrust share (or trust share): how much of the
rank that comes to it over links starts at blocked (allowed) pages. Dividing takes out how popular the
hosts are, which the mass alone measures, so links that lead to a host do not lower its distrust share.

A url without a rule is blocked if rules block a share of its host's pages that reaches a threshold and
exceeds the allowed one, or if the host's distrust share reaches the threshold and exceeds both its
allowed share and its trust share, which links from trusted hosts can raise.

Cases: a null url or one without `://` has empty host and path, fits no rule and is judged as the
host ``''``. Null html has no links. Relative links and links to the own host carry nothing. Equal
pages each count. A url without a path has the path ``''``, which no rule with a path fits. Of two
equally long rules that fit, the first in their list decides. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import stage, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links with a host of their own; relative links stay on their host.
LINK = r"""(?i)<a[ \t-\r][^>]*?href[ \t-\r]*=[ \t-\r]*["']?[ \t-\r]*(?:https?:)?//([^/?#"' \t-\r>]+)"""
#: host, path prefix and verdict of the registered query, in the order given.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_table(spark: SparkSession, rules) -> DataFrame:
    rows = [(h, p, v, h + p, len(h + p), -i) for i, (h, p, v) in enumerate(rules)]
    schema = "rule_host string, prefix string, rule_verdict string, rule string, size int, place int"
    return spark.createDataFrame(rows, schema)


def _fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every host with the rules of its own name and of its parents, longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return (
        hosts.select("host", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host")
        .agg(
            F.sort_array(
                F.collect_set(F.struct("size", "place", "rule", "prefix", "rule_verdict")), asc=False
            ).alias("rules")
        )
    )


def ruled(pages: DataFrame, rules) -> DataFrame:
    """page_id, host, path, rule, rule_verdict of every page; the last two null without a rule.

    Only distinct hosts meet the rules, and pages meet their host's rules in one join, which
    adaptive execution splits where a host has very many pages.
    """
    parsed = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    hosts = parsed.select("host").distinct()
    fitting = _fitting(hosts, _rule_table(pages.sparkSession, rules))
    first = F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"]))
    return (
        parsed.join(fitting, "host", "left")
        .withColumn("_fit", F.try_element_at(first, F.lit(1)))
        .select("page_id", "host", "path", "_fit.rule", "_fit.rule_verdict")
    )


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and the number of links from pages of src to pages of another host dst."""
    found = F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))
    return (
        pages.select(url_host(F.col("url")).alias("src"), F.explode(found).alias("_to"))
        .select("src", F.translate("_to", UPPER, LOWER).alias("dst"))
        .where(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def _moves(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where a host's trust and distrust go: src, dst, trust share, distrust share.

    Trust leaves along links and distrust against them; a host with nowhere to send it keeps it.
    """
    out = links.groupBy("src").agg(F.sum("links").alias("total"))
    into = links.groupBy("dst").agg(F.sum("links").alias("total"))
    zero, one = F.lit(0.0), F.lit(1.0)
    part = F.col("links") / F.col("total")
    along = links.join(out, "src").select("src", "dst", part.alias("wt"), zero.alias("wd"))
    against = links.join(into, "dst").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), zero.alias("wt"), part.alias("wd")
    )
    ends = nodes.join(out.select(F.col("src").alias("host")), "host", "left_anti")
    starts = nodes.join(into.select(F.col("dst").alias("host")), "host", "left_anti")
    same = [F.col("host").alias("src"), F.col("host").alias("dst")]
    keep_trust = ends.select(*same, one.alias("wt"), zero.alias("wd"))
    keep_distrust = starts.select(*same, zero.alias("wt"), one.alias("wd"))
    return along.unionAll(against).unionAll(keep_trust).unionAll(keep_distrust)


def spread_trust(
    links: DataFrame, seeds: DataFrame, damping: float = 0.6, rounds: int = 12, cut_every: int = 4
) -> DataFrame:
    """host, both seeds, trust, distrust, trust_share and distrust_share after `rounds` steps.

    links: src, dst, links. seeds: host, trust_seed, distrust_seed between 0 and 1. What a host
    has is (1 - damping) of its seed plus damping times what reaches it. The shares compare what came
    over links in the last step with what came from seeds of one; they are 0 where nothing came. Every
    round is one join and one sum over the links; every `cut_every` rounds the state is written.
    Without links all hosts keep their seeds and no round is run.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    ends = links.select(F.col("src").alias("host")).unionAll(links.select(F.col("dst").alias("host")))
    unseeded = ends.distinct().select("host", zero.alias("trust_seed"), zero.alias("distrust_seed"))
    nodes = stage(
        seeds.select("host", "trust_seed", "distrust_seed")
        .unionAll(unseeded)
        .groupBy("host")
        .agg(F.max("trust_seed").alias("trust_seed"), F.max("distrust_seed").alias("distrust_seed"))
    )
    walks = {"trust": ("trust_seed", "wt"), "distrust": ("distrust_seed", "wd")}
    start = []
    for walk, (seed, _) in walks.items():
        start += [F.col(seed).alias(walk), one.alias(f"{walk}_all"), zero.alias(f"{walk}_share")]
    state = nodes.select("host", "trust_seed", "distrust_seed", *start)
    if links.isEmpty():
        return state.drop("trust_all", "distrust_all")
    moves = stage(_moves(links, nodes.select("host")))
    from_others = F.col("src") != F.col("dst")
    for step in range(1, rounds + 1):
        sums, after = [], []
        for walk, (seed, weight) in walks.items():
            for name, first in ((walk, F.col(seed)), (f"{walk}_all", one)):
                moved = F.col(name) * F.col(weight)
                sums.append(F.sum(moved).alias(f"{name}_in"))
                sums.append(F.sum(F.when(from_others, moved)).alias(f"{name}_received"))
                come = F.coalesce(f"{name}_in", zero)
                after.append(((1 - damping) * first + damping * come).alias(name))
            share = F.try_divide(F.col(f"{walk}_received"), F.col(f"{walk}_all_received"))
            after.append(F.coalesce(share, zero).alias(f"{walk}_share"))
        values = state.select("host", *[name for walk in walks for name in (walk, f"{walk}_all")])
        reached = (
            moves.join(values, moves["src"] == values["host"])
            .groupBy("dst")
            .agg(*sums)
            .withColumnRenamed("dst", "host")
        )
        state = nodes.join(reached, "host", "left").select("host", "trust_seed", "distrust_seed", *after)
        if step % cut_every == 0 or step == rounds:
            state = stage(state)
    return state.drop("trust_all", "distrust_all")


def filter_urls(
    pages: DataFrame,
    rules=RULES,
    threshold: float = 0.5,
    damping: float = 0.6,
    rounds: int = 12,
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, trust_share, distrust_share of every row of
    pages(page_id, url, html).

    A host's seeds are the shares of its pages that rules allow and block, so a threshold of 0.5
    blocks the rest of a host if rules block half of its pages and allow fewer, whatever its links.
    """
    pages = pages.select("page_id", "url", "html")
    judged = ruled(pages, rules)
    seeds = judged.groupBy("host").agg(
        F.avg(F.when(F.col("rule_verdict") == "allow", 1.0).otherwise(0.0)).alias("trust_seed"),
        F.avg(F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)).alias("distrust_seed"),
    )
    links = stage(host_links(pages))
    scores = spread_trust(links, stage(seeds), damping, rounds)
    own = (F.col("distrust_seed") >= threshold) & (F.col("distrust_seed") > F.col("trust_seed"))
    trusted = F.greatest("trust_seed", "trust_share")
    by_links = (F.col("distrust_share") >= threshold) & (F.col("distrust_share") > trusted)
    return judged.join(scores, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(own | by_links, "block").otherwise("allow")).alias("verdict"),
        "trust",
        "distrust",
        "trust_share",
        "distrust_share",
    )


def op8_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages"))
    # Rounded, as sums over hosts come in any order.
    scores = [F.round(c, 9).alias(c) for c in ("trust", "distrust", "trust_share", "distrust_share")]
    return found.select("page_id", "host", "path", "rule", "verdict", *scores)


def _walk_sql(name: str, seed: str, source: str, target: str, damping: float, rounds: int) -> list[str]:
    """The steps of one walk, each a table: now and total have what is there, got and got_all what came over links."""
    total = f"{name}_out"
    steps = [
        f"{total} AS (SELECT {source} AS h, sum(links) AS total FROM host_links GROUP BY 1)",
        f"{name}0 AS (SELECT h, {seed} AS now, 1.0::DOUBLE AS total, 0.0::DOUBLE AS got, 0.0::DOUBLE AS got_all FROM nodes)",
    ]
    for step in range(1, rounds + 1):
        before = f"{name}{step - 1}"
        steps.append(f"""{name}{step} AS MATERIALIZED (
    SELECT n.h,
           {1 - damping} * n.{seed} + {damping} * (coalesce(g.got, 0) + CASE WHEN o.h IS NULL THEN b.now ELSE 0 END) AS now,
           {1 - damping} + {damping} * (coalesce(g.got_all, 0) + CASE WHEN o.h IS NULL THEN b.total ELSE 0 END) AS total,
           coalesce(g.got, 0) AS got, coalesce(g.got_all, 0) AS got_all
    FROM nodes n JOIN {before} b ON b.h = n.h LEFT JOIN {total} o ON o.h = n.h LEFT JOIN (
        SELECT e.{target} AS h, sum(b.now * e.links / o.total) AS got, sum(b.total * e.links / o.total) AS got_all
        FROM host_links e JOIN {before} b ON b.h = e.{source} JOIN {total} o ON o.h = e.{source} GROUP BY 1
    ) g ON g.h = n.h)""")
    return steps


def filter_sql(rules=RULES, threshold: float = 0.5, damping: float = 0.6, rounds: int = 12) -> str:
    """DuckDB SQL for the rows of `op8_url_graph` with these parameters."""
    named = ", ".join(f"({i}, '{h}', '{p}', '{v}')" for i, (h, p, v) in enumerate(rules))
    lower = f"'{UPPER}', '{LOWER}'"
    link = LINK.replace("'", "''")
    steps = [
        f"rules(place, rule_host, prefix, rule_verdict) AS (VALUES {named})",
        f"""parsed AS (
    SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {lower}), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages)""",
        """judged AS (
    SELECT page_id, host, path, html, (
        SELECT arg_max({'rule': rule_host || prefix, 'verdict': rule_verdict}, length(rule_host || prefix) * 1000 - place)
        FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix)) AS fit
    FROM parsed)""",
        f"""found AS (
    SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS target FROM parsed)""",
        f"""host_links AS MATERIALIZED (
    SELECT src, translate(target, {lower}) AS dst, count(*) AS links FROM found
    WHERE src <> translate(target, {lower}) GROUP BY 1, 2)""",
        """nodes AS MATERIALIZED (
    SELECT h, max(trust_seed) AS trust_seed, max(distrust_seed) AS distrust_seed FROM (
        SELECT host AS h, avg(CASE WHEN fit.verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS trust_seed,
               avg(CASE WHEN fit.verdict = 'block' THEN 1.0 ELSE 0.0 END) AS distrust_seed
        FROM judged GROUP BY 1
        UNION ALL SELECT src, 0.0, 0.0 FROM host_links UNION ALL SELECT dst, 0.0, 0.0 FROM host_links) GROUP BY 1)""",
        *_walk_sql("trust", "trust_seed", "src", "dst", damping, rounds),
        *_walk_sql("distrust", "distrust_seed", "dst", "src", damping, rounds),
        f"""scores AS (
    SELECT h, trust_seed, distrust_seed, t.now AS trust, d.now AS distrust,
           CASE WHEN t.got_all > 0 THEN t.got / t.got_all ELSE 0.0 END AS trust_share,
           CASE WHEN d.got_all > 0 THEN d.got / d.got_all ELSE 0.0 END AS distrust_share
    FROM nodes JOIN trust{rounds} t USING (h) JOIN distrust{rounds} d USING (h))""",
    ]
    return "WITH " + ",\n".join(steps) + f"""
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.verdict, CASE
           WHEN distrust_seed >= {threshold} AND distrust_seed > trust_seed THEN 'block'
           WHEN distrust_share >= {threshold} AND distrust_share > greatest(trust_seed, trust_share) THEN 'block'
           ELSE 'allow' END) AS verdict,
       round(trust, 9) AS trust, round(distrust, 9) AS distrust,
       round(trust_share, 9) AS trust_share, round(distrust_share, 9) AS distrust_share
FROM judged JOIN scores ON scores.h = judged.host
"""


OP8_SQL = filter_sql()
