"""URL filters by link-graph propagation.

Rules name a host and a path; a rule fits its host and all subdomains if the url's path starts with
the rule's, and the longest rule wins. Where no rule fits, the host's standing decides. Trust flows
from hosts with allowed pages along host edges (personalised PageRank); distrust flows from hosts
with blocked pages against them: a host that links to distrusted hosts is distrusted. Both start
with each host's share of allowed and of blocked pages, and a host is blocked if its distrust
exceeds MARGIN times its trust and FLOOR times the share of an average host. Scores are those of the
settled walk: rounds go on until what is still on its way is less than TOLERANCE times that floor.

Host edges are the absolute and protocol-relative links in pages' html. Where pages tell nothing, a family
edge stands in: a host without any link from or to another host and its nearest parent domain among
the hosts (or such a parent and its subdomain) link to each other, with the weight of `family` links;
0 leaves these edges out. Edges and
scores are summed per host before each shuffle, so a hot host is one row; each round is one join and
one sum over the edges and is written to the shared folder, so lost executors cost one round.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule, has no
edges and is allowed; a null html has no links; links of a host to itself are left out; whole pages
are read, however long; repeated pages count as often; further columns go; distrust equal to the
floor or to MARGIN times the trust doesn't block; a host without any score is allowed; hosts with nowhere to pass their score on
give it back to the seeds; an empty table gives no rows. Equal rules count once; of rules equally
long the blocking one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, discard, scratch, table

#: The rules of the registered query: host, path, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DAMPING, MARGIN, FLOOR, FAMILY = 0.85, 1.0, 0.5, 1.0
ROUNDS = 250  #: of the SQL: what is on its way then is far below any tolerance
TOLERANCE = 1e-3  #: of FLOOR times an average host's share: the part of the scores of a kind that may still be on its way
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged_by_rules(host: Column, path: Column, rules=RULES) -> Column:
    """The rule that fits, as struct(rule, verdict); null where none does. Rules are a short list: one condition each."""
    order = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(order):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame, hosts: DataFrame, family: float = FAMILY) -> DataFrame:
    """src, dst and n, the links (or what stands in for them), between the hosts of hosts(host)."""
    links = (
        pages.where("host <> ''")
        .select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
        .groupBy(F.col("host").alias("src"), ascii_lower("to").alias("dst"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    known = links.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst", "n")
    known = cut(known, "graph-links")
    # a parent is a known host, so only endings as long as one are looked up, however many labels a host has
    lengths = hosts.where("host <> ''").select(F.length("host").alias("n")).distinct().agg(F.sort_array(F.collect_list("n"))).first()[0]
    n = F.length("host")
    endings = F.filter(F.lit(lengths).cast("array<int>"), lambda x: (x < n) & (F.substr("host", n - x, F.lit(1)) == "."))
    parents = hosts.select("host", F.explode(F.transform(endings, lambda x: F.right("host", x))).alias("parent"))
    nearest = parents.join(hosts.select(F.col("host").alias("parent")), "parent", "left_semi").groupBy("host").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    met = known.select(F.col("src").alias("host")).union(known.select("dst")).distinct()
    of = lambda c: met.select(F.col("host").alias(c), F.lit(True).alias(f"{c}_met"))
    alone = nearest.join(of("host"), "host", "left").join(of("parent"), "parent", "left").where("host_met is null or parent_met is null")
    both = alone.select(F.col("host").alias("src"), F.col("parent").alias("dst")).unionByName(alone.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    edges = known.unionByName(both.withColumn("n", F.lit(float(family)))) if family > 0 else known
    return cut(edges, "graph-edges")


def converged(edges: DataFrame, seeds: DataFrame, tolerance: float) -> DataFrame:
    """kind, host and score: for each kind the personalised PageRank of seeds(kind, host, seed) over edges(kind, src, dst, n).

    The seeds of a kind sum to 1. A round sends DAMPING of each score along the edges; what is not
    sent, or has no edge to go along, goes to the seeds. Rounds go on until the scores of a kind differ by less than tolerance
    in all from the settled ones. All that is not sent goes to the seeds, so settled scores are in proportion to what the seeds and
    all that they send, directly and on, add up to. A round sends the last one's part; DAMPING
    bounds what all later rounds can add.
    """
    total = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    ways = cut(edges.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("share")), "graph-ways")
    state = seeds.groupBy("kind", "host").agg(F.sum("seed").alias("part")).withColumn("score", F.col("part"))
    while True:
        sent = ways.join(state.where("part > 0").select("kind", F.col("host").alias("src"), "part"), ["kind", "src"])
        sent = sent.select("kind", F.col("dst").alias("host"), (DAMPING * F.col("part") * F.col("share")).alias("part"), F.lit(0.0).alias("score"))
        both = sent.unionByName(state.select("kind", "host", F.lit(0.0).alias("part"), "score")).groupBy("kind", "host")
        last, state = state, cut(both.agg(F.sum("part").alias("part"), (F.sum("score") + F.sum("part")).alias("score")), "graph-scores")
        if hasattr(last, "_cut_to"):
            discard(last)
        sums = state.groupBy("kind").agg(F.sum("part").alias("part"), F.sum("score").alias("whole")).collect()  # one row a kind
        # what is to come is at most part * DAMPING / (1 - DAMPING), and changes the scaled scores by at most twice its share
        if all(2 * r["part"] * DAMPING / (1 - DAMPING) < tolerance * r["whole"] for r in sums):
            break
    whole = F.lit(1.0)
    for row in sums:
        whole = F.when(F.col("kind") == row["kind"], F.lit(row["whole"])).otherwise(whole)
    return state.select("kind", "host", (F.col("score") / whole).alias("score"))


def host_standing(pages: DataFrame, family: float = FAMILY) -> DataFrame:
    """host, trust, distrust and blocked of every host, from pages(host, rule_verdict, html)."""
    with scratch() as kept:
        kept.append(_standing(pages, family))
        return kept[0]


def _standing(pages: DataFrame, family: float) -> DataFrame:
    kinds = {"trust": "allowed", "distrust": "refused"}
    allowed, refused = (F.count_if(F.col("rule_verdict") == v).cast("double") for v in ("allow", "block"))
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), allowed.alias("allowed"), refused.alias("refused"))
    hosts = cut(hosts, "graph-hosts")
    edges = host_edges(pages, hosts, family)
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    totals = hosts.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c) / F.col("pages")).alias(k) for k, c in kinds.items())).first()
    seeds = [
        hosts.where(f"{c} > 0").select(F.lit(k).alias("kind"), "host", (F.col(c) / F.col("pages") / F.lit(totals[k] or 1.0)).alias("seed")) for k, c in kinds.items()
    ]
    floor = FLOOR / max(1, totals["n"])
    scores = converged(edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(back), cut(seeds[0].unionByName(seeds[1]), "graph-seeds"), TOLERANCE * floor)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    bad = (F.col("distrust") > MARGIN * F.col("trust") + 1e-12) & (F.col("distrust") > floor)
    return cut(scores.groupBy("host").agg(*map(of, kinds)).withColumn("blocked", bad), "graph-standing")


def filter_urls(pages: DataFrame, rules=RULES, family: float = FAMILY) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each row of pages(page_id, url, html)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    split = split.withColumn("told", judged_by_rules(F.col("host"), F.col("path"), rules))
    standing = host_standing(split.select("host", F.col("told.verdict").alias("rule_verdict"), "html"), family)
    judged = split.drop("html").join(standing, "host", "left")
    by_graph = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "told.rule", F.coalesce("told.verdict", by_graph).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op2_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}', {len(h + p)})" for h, p, v in RULES)
    link = LINK.replace("'", "''")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        rf"""p AS (SELECT page_id, html, coalesce({lower.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        f"r(name, start, verdict, size) AS (VALUES {rules})",
        """j AS (SELECT p.*, (SELECT {'rule': name || start, 'verdict': verdict} FROM r WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  ORDER BY size DESC, verdict DESC LIMIT 1) AS told FROM p)""",
        "h AS (SELECT host, count(*) AS pages, count(*) FILTER (told.verdict = 'allow') AS good, count(*) FILTER (told.verdict = 'block') AS bad FROM j WHERE host <> '' GROUP BY host)",
        f"l AS (SELECT host AS src, {lower.format('x')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS x FROM j WHERE host <> ''))",
        "n AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND dst IN (SELECT host FROM h) GROUP BY ALL)",
        "m AS (SELECT src AS host FROM n UNION SELECT dst FROM n)",
        """f AS (SELECT c.host AS child, arg_max(q.host, length(q.host)) AS parent FROM h c JOIN h q ON ends_with(c.host, '.' || q.host) GROUP BY c.host)""",
        "a AS (SELECT child, parent FROM f WHERE child NOT IN (SELECT host FROM m) OR parent NOT IN (SELECT host FROM m))",
        f"e AS (SELECT src, dst, n::DOUBLE AS n FROM n UNION ALL SELECT child, parent, {FAMILY} FROM a UNION ALL SELECT parent, child, {FAMILY} FROM a)",
    ]
    for k, share, src, dst in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        parts.append(f"{k}s AS (SELECT host, {share} / pages / (SELECT sum({share} / pages) FROM h) AS seed FROM h WHERE {share} > 0)")
        parts.append(f"{k}w AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS share FROM e)")
        parts.append(f"{k}r AS (SELECT 0 AS round, host, seed AS part FROM {k}s UNION ALL SELECT any_value(round) + 1, dst, {DAMPING} * sum(part * share) FROM {k}r JOIN {k}w ON host = src WHERE round < {ROUNDS} GROUP BY dst)")
        parts.append(f"{k}x AS MATERIALIZED (SELECT host, sum(part) / (SELECT sum(part) FROM {k}r) AS score FROM {k}r GROUP BY host)")
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + f"""
SELECT page_id, j.host, path, told.rule AS rule, coalesce(told.verdict, CASE WHEN coalesce(d.score, 0) > {MARGIN} * coalesce(t.score, 0) + 1e-12
  AND coalesce(d.score, 0) > {FLOOR} / (SELECT count(*) FROM h) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN tx t ON t.host = j.host LEFT JOIN dx d ON d.host = j.host"""
    )


SQL = _sql()
