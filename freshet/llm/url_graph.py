"""URL filter by trust and distrust that spread over the host graph.

Rules judge what they fit. Hosts with pages that the rules allow are trusted seeds, hosts with pages
that they block are distrusted ones, each weighted by the number of these pages; a host can be both.
Trust spreads along host edges by personalised PageRank; distrust spreads against them, since who
links to a blocked host is suspect. Both move in the same rounds. A host whose share of trust
falls below a threshold is blocked, and so are its pages that no rule judges.

Host edges are the links in the pages that name a host, quoted or not, with a scheme or with `//`
alone; besides, a host and the host left after its first label (as in m.example.org and
example.org) vouch for each other, by one over the number of the parent's children. With `domains` this goes on label by label down to two labels,
and domains without pages of their own are nodes as well, so hosts of one domain reach each other;
without it both hosts need pages. Names of more than 253 characters and numeric addresses have no
domain. Edges of equal ends are summed first, so a hot host is one row per neighbour, and the
neighbours of a host are dealt to parts. Edges are keyed and written once, in as many partitions as they
fill; a round is one join and one partial aggregate. Lineage is cut into the checkpoint folder every few rounds.

Defined cases: a url that is null or has no `://` has an empty host and path, fits no rule and is
allowed; null html has no links; repeated pages count repeatedly; a host without any mass is
allowed; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Target of a link that names a host, with or without quotes and scheme.
LINK = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'<>\s]+)"""
#: Longest name of a host; longer ones and numeric addresses have no domain.
HOST_CHARS = 253
#: Edges in a partition, and neighbours of a host that one task moves mass to.
PART_EDGES = 100_000
#: Part of an even share of distrust from which on a host can be blocked.
LEAST_LIFT = 0.05


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Host of a url with A-Z lower-cased; empty without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null. Rules are a short list of literals."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def domain_chains(hosts: DataFrame) -> DataFrame:
    """(src, dst): each of `hosts` (src) and its parents down to two labels, with the parent of each; distinct.

    One row per label of a host, which its name bounds. Siblings share the rows of their domain.
    """
    named = hosts.where((F.length("src") <= HOST_CHARS) & ~F.col("src").rlike(r"\.[0-9]+(:[0-9]*)?$"))
    labels = named.select(F.split("src", r"\.").alias("_l")).where(F.size("_l") > 2)
    at = labels.select("_l", F.explode(F.sequence(F.lit(1), F.size("_l") - 2)).alias("_k"))

    def rest(first: Column) -> Column:
        return F.array_join(F.slice("_l", first, F.size("_l")), ".")

    return at.select(rest(F.col("_k")).alias("src"), rest(F.col("_k") + 1).alias("dst")).distinct()


def kin_edges(pages_hosts: DataFrame, domains: bool) -> DataFrame:
    """(src, dst, weight): a host and its parent vouch for each other, by one over the number of the parent's children."""
    if domains:
        known = domain_chains(pages_hosts)
    else:
        parents = pages_hosts.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst")).where("src <> dst")
        known = parents.join(pages_hosts.select(F.col("src").alias("dst")), "dst", "left_semi")
    children = known.groupBy("dst").agg((1 / F.count(F.lit(1))).alias("weight"))
    weighed = known.join(children, "dst").select("src", "dst", "weight")
    return weighed.unionByName(weighed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html", domains: bool = False) -> DataFrame:
    """(src, dst, weight): links between different hosts, and kinship of hosts with pages or with `domains`.

    A link counts one; kin of a parent with many children counts as little as one over their number.
    """
    found = F.regexp_extract_all(F.col(html), F.lit(LINK), 1)
    linked = pages.select(url_host(F.col(url)).alias("src"), F.explode_outer(found).alias("_to")).where("src <> ''")
    to = F.when(F.col("_to").startswith("//"), F.concat(F.lit("http:"), "_to")).otherwise(F.col("_to"))
    # Pages are read once: a row without target stands for a host whose pages link nowhere.
    counted = cut_lineage(linked.select("src", url_host(to).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    links = counted.where("dst <> '' and src <> dst")
    kin = kin_edges(counted.select("src").distinct(), domains)
    return links.unionByName(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def sized(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` of `rows` rows dealt by `keys` to as many partitions as they fill; a small table is one, and is joined without a shuffle."""
    parts = -(-rows // PART_EDGES)
    return df.coalesce(1) if parts <= 1 else df.repartition(parts, *keys)


def steps(edges: DataFrame) -> DataFrame:
    """(src, salt, dst, trust, distrust, dst_salts): shares of a host's masses that move on to a neighbour.

    Trust follows an edge by its part of the weight that leaves its source, distrust goes back by its
    part of the weight that reaches its target. The neighbours of a host are dealt to parts (`salt`) of at most about
    PART_EDGES, so a domain with many children is the work of several tasks.
    """
    kept = cut_lineage(edges)
    rows = kept.count()
    kept = sized(kept, rows, "src")
    leaves = kept.groupBy("src").agg(F.sum("weight").alias("_out"))
    reaches = kept.groupBy("dst").agg(F.sum("weight").alias("_in"))
    zero = F.lit(0.0)
    along = kept.join(leaves, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("trust"), zero.alias("distrust"))
    against = kept.join(reaches, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), zero.alias("trust"), (F.col("weight") / F.col("_in")).alias("distrust"))
    both = cut_lineage(sized(along.unionByName(against).groupBy("src", "dst").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), 2 * rows, "src"))
    salts = both.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / PART_EDGES).cast("int").alias("salts"))
    salted = both.join(salts, "src").withColumn("salt", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int")).drop("salts")
    named = salted.join(salts.select(F.col("src").alias("dst"), F.col("salts").alias("dst_salts")), "dst", "left")
    return cut_lineage(sized(named.select("src", "salt", "dst", "trust", "distrust", F.coalesce("dst_salts", F.lit(0)).alias("dst_salts")), 2 * rows, "src", "salt"))


def spread(moves: DataFrame, seeds: DataFrame, tolerance: float = 1e-4, damping: float = 0.85, cut_every: int = 5, most_rounds: int = 200) -> DataFrame:
    """Personalised PageRank of both masses at once: (host, trust, distrust) from `seeds` (host, trust, distrust).

    `moves` is `steps` of the edges. Masses only grow from round to round, so the mass gained in the
    last `cut_every` rounds is the change; by the damping what is still to come is at most
    c / (1 - c) times that, c = damping ** cut_every. Rounds end when this is below `tolerance` (of
    two, the sum of all seeds), or at `most_rounds`. Mass on a host without edges goes no further.
    """
    salts = moves.groupBy("src").agg((F.max("salt") + 1).alias("salts"))
    first = seeds.join(salts, seeds["host"] == salts["src"], "left").select(
        "host", *((F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")), F.coalesce("salts", F.lit(0)).alias("salts")
    )
    n = moves.count()
    start = cut_lineage(sized(first, n, "host"))
    mass, before, left = start, 0.0, damping ** cut_every
    for k in range(1, most_rounds + 1):
        copies = mass.where("salts > 0").select("host", "trust", "distrust", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"))
        met = copies.alias("m").join(moves.alias("s"), (F.col("m.host") == F.col("s.src")) & (F.col("m._salt") == F.col("s.salt")))
        moved = met.select(
            F.col("s.dst").alias("host"), *((F.col(f"m.{c}") * F.col(f"s.{c}") * damping).alias(c) for c in ("trust", "distrust")), F.col("s.dst_salts").alias("salts")
        )
        together = moved.unionByName(start)
        # The union of two single partitions is two; one is enough where one held each.
        mass = (together.coalesce(1) if n <= PART_EDGES else together).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), F.max("salts").alias("salts"))
        if k % cut_every == 0:
            mass = cut_lineage(mass)
            now = mass.agg(F.coalesce(F.sum(F.col("trust") + F.col("distrust")), F.lit(0.0))).first()[0]
            if (now - before) * left / (1 - left) <= tolerance:
                break
            before = now
    return mass.drop("salts")


def host_seeds(judged: DataFrame) -> DataFrame:
    """(host, trust, distrust): hosts with pages that the rules judge, each verdict weighted by these pages."""
    hits = judged.where((F.col("host") != "") & F.col("_by_rule").isNotNull())
    hosts = cut_lineage(hits.groupBy("host").agg(*(F.count(F.when(F.col("_by_rule.verdict") == v, 1)).cast("double").alias(c) for v, c in (("allow", "trust"), ("block", "distrust")))))
    total = hosts.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    return hosts.select("host", *((F.col(c) / F.lit(total[c] or 1.0)).alias(c) for c in ("trust", "distrust")))


def judge_pages(
    pages: DataFrame, rules: tuple[Rule, ...], threshold: float = 0.5, tolerance: float = 1e-4, key: str = "page_id",
    url: str = "url", html: str = "html", domains: bool = False, least_lift: float = LEAST_LIFT,
) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, trust, distrust (masses of its host).

    Without a rule a page is blocked if its host has at least `least_lift` times an even share of all
    distrust, one over the number of hosts that have any mass, and trust / (trust + distrust) is below `threshold`.
    So one blocked page does not condemn the thousands of hosts of a large domain, where little of it arrives.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    judged = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("_by_rule", match_rules(F.col("host"), F.col("path"), rules))
    masses = spread(steps(host_edges(pages, url, html, domains)), host_seeds(judged), tolerance)
    hosts = masses.count()
    share = F.col("trust") / (F.col("trust") + F.col("distrust"))
    by_host = F.when((F.col("distrust") * hosts >= least_lift) & (share < threshold), "block").otherwise("allow")
    return judged.join(masses, "host", "left").select(
        F.col("_key").alias(key), "host", "path", F.col("_by_rule.rule").alias("rule"),
        F.coalesce(F.col("_by_rule.verdict"), by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
