"""URL verdicts: rules where one fits, else trust and distrust propagated over the graph of hosts.

A rule is a host (or domain) and a path prefix; of the rules that fit an url the longest decides. Pages that a rule decides
seed the graph: allowed ones their host's trust, blocked ones its distrust. Trust is a personalised PageRank along the edges
(whom a trusted host links to is trusted), distrust one along the reversed edges (who links to a blocked host is not). A host
whose distrust is above its trust is blocked.

Edges are the links that a page's html has to other hosts, one per page and host, and one each way between a host and the
domain it is part of (down to two labels), since one owner stands behind both.

Host graphs are aggregates of all pages, and each iteration is one equi-join on the host and one aggregate; nothing is
collected but the largest change of a score, which ends the rounds once it is small, and a host with a third of all pages is summed map-side.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; null html has no
links; a host that no seed reaches is allowed; repeated rows count as pages of their own; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import lower_ascii
from barloom.session import stage

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
# Rounds go on until none of the last STAGE_EVERY has changed a host's score by more than this share of it. A host that is
# reached for the first time changes by all of it, so chains are followed to their ends.
TOLERANCE = 1e-4
# Scores below this count as unchanged: they have no digits left to settle.
LEAST = 1e-300
# The SQL writes out this many rounds, which is the same on tables without longer chains or closer ties.
ROUNDS = 12
# Rounds between two cuts of the lineage.
STAGE_EVERY = 4
# Distrust counts as above trust if it is by this share of the trust, so that the order of sums does not decide. A share,
# since scores shrink as the table grows.
MARGIN = 1e-9
# The SQL compares to this many digits instead, which is the same on tables without scores below them.
DIGITS = 9
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(whole, _URL, 1)), F.regexp_extract(whole, _URL, 2)


def matched(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, and the rule that decides with its verdict (both null where none fits)."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is outermost
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return out.withColumns({"rule": rule, "verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of src that link to dst, and the ties between hosts and their domains."""
    host, _ = host_and_path(F.col("url"))
    links = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))
    linked = pages.select(host.alias("src"), F.explode(links).alias("dst")).select("src", lower_ascii(F.col("dst")).alias("dst"))
    linked = linked.where("src != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    names = pages.select(host.alias("h")).unionByName(linked.select(F.col("dst").alias("h"))).where("h != ''").distinct()
    labels = F.split("h", "[.]")
    chain = F.transform(
        F.sequence(F.lit(1), F.size("l") - 1),
        lambda i: F.struct(
            F.array_join(F.slice("l", i, F.size("l")), ".").alias("src"), F.array_join(F.slice("l", i + 1, F.size("l")), ".").alias("dst")
        ),
    )
    ties = names.withColumn("l", labels).where(F.size("l") > 2).select(F.explode(F.slice(chain, F.lit(1), F.size("l") - 2)).alias("e"))
    ties = ties.select("e.*").distinct()
    both = ties.unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _change(now: DataFrame, before: DataFrame) -> float:
    """The largest change of a score as a share of it, over all hosts; one row leaves the executors."""
    old = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
    share = lambda new, was: F.when(F.col(new) > LEAST, F.abs(F.col(new) - F.col(was)) / F.col(new)).otherwise(0.0)
    return now.join(old, "host").agg(F.max(F.greatest(share("trust", "t"), share("distrust", "d")))).first()[0] or 0.0


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of all hosts of `edges` (src, dst, weight) and `seeds` (host, trust, distrust); each seed
    column sums to 1, or to 0 where there are none. Mass of a host without edges onward is not passed on."""
    outward = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    inward = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    along = edges.join(outward, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(inward, "dst").select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("t"), (F.col("weight") / F.col("total")).alias("d")
    )
    flows = stage(along.unionByName(back).groupBy("src", "dst").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    hosts = flows.select(F.col("src").alias("host")).unionByName(seeds.select("host")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = stage(hosts.join(seeds, "host", "left").select("host", zero("trust").alias("trust0"), zero("distrust").alias("distrust0")))
    now = base.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    while True:
        before = now
        for _ in range(STAGE_EVERY):
            moved = (
                flows.join(now, flows.src == now.host)
                .groupBy("dst")
                .agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
            )
            new = lambda seed, flow: F.col(seed) * (1 - damping) + zero(flow) * damping
            now = base.join(moved, base.host == moved.dst, "left").select(
                "host", new("trust0", "t").alias("trust"), new("distrust0", "d").alias("distrust")
            )
        now = stage(now)
        if _change(now, before) <= tolerance:
            return now


def seeds_of(found: DataFrame) -> DataFrame:
    """(host, trust, distrust): each host's share of the pages that rules allow and block."""
    per_host = found.where("rule is not null").groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")
    )
    per_host = stage(per_host)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), per_host.agg(F.sum(c)).scalar()), F.lit(0.0))
    return per_host.select("host", share("a").alias("trust"), share("b").alias("distrust"))


def blocked() -> Column:
    """Whether a host's distrust is above its trust, at any scale of the two."""
    return F.col("distrust") > F.col("trust") * (1 + MARGIN)


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of every page."""
    found = stage(matched(pages, rules))
    ranked = propagate(host_edges(pages), stage(seeds_of(found)))
    judged = ranked.select("host", F.when(blocked(), "block").otherwise("allow").alias("of_host"))
    verdict = F.coalesce("verdict", "of_host", F.lit("allow"))
    return found.join(judged, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle(rules=RULES) -> str:
    """DuckDB SQL for `filter_urls`, its rounds written out."""
    fits = "".join(
        f" when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{}}"
        for _, h, p in sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    )
    ordered = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    rule = "case" + fits.format(*[f"'{h}{p}'" for _, h, p in ordered]) + " end"
    verdict = "case" + fits.format(*[f"'{k}'" for k, _, _ in ordered]) + " end"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = _LINK.replace("'", "''")
    steps = "".join(
        f""",
s{i} as materialized (select b.host, trust0 * {1 - DAMPING!r} + coalesce(m.t, 0) * {DAMPING} as trust,
    distrust0 * {1 - DAMPING!r} + coalesce(m.d, 0) * {DAMPING} as distrust
  from b left join (select dst, sum(t * trust) as t, sum(d * distrust) as d from flows join s{i - 1} on src = host group by dst) m
  on b.host = m.dst)"""
        for i in range(1, ROUNDS + 1)
    )
    return f"""
with p0 as (select page_id, html, {lower.format(f"regexp_extract(coalesce(url, ''), '{_URL}', 1)")} as host,
    regexp_extract(coalesce(url, ''), '{_URL}', 2) as path from pages),
p as materialized (select page_id, html, host, path, {rule} as rule, {verdict} as verdict from p0),
links as (select host as src, {lower.format("dst")} as dst, count(*) as weight
  from (select host, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{link}', 1))) as dst from p)
  where host != '' and host != {lower.format("dst")} group by all),
names as (select distinct h, string_split(h, '.') as l from (select host as h from p union all select dst from links) where h != ''),
ties as (select distinct array_to_string(l[i:], '.') as src, array_to_string(l[i + 1:], '.') as dst
  from (select l, unnest(range(1, len(l) - 1)) as i from names where len(l) > 2)),
e as materialized (select src, dst, cast(sum(weight) as double) as weight from (select * from links
  union all select src, dst, 1 from ties union all select dst, src, 1 from ties) group by all),
flows as materialized (select src, dst, sum(t) as t, sum(d) as d from (
  select src, dst, weight / sum(weight) over (partition by src) as t, 0.0 as d from e
  union all select dst, src, 0.0, weight / sum(weight) over (partition by dst) from e) group by all),
seeds as materialized (select host, coalesce(a / nullif(sum(a) over (), 0), 0) as trust, coalesce(b / nullif(sum(b) over (), 0), 0) as distrust
  from (select host, count_if(verdict = 'allow') as a, count_if(verdict = 'block') as b from p where rule is not null group by host)),
b as materialized (select host, coalesce(trust, 0) as trust0, coalesce(distrust, 0) as distrust0
  from (select src as host from flows union select host from seeds) left join seeds using (host)),
s0 as (select host, trust0 as trust, distrust0 as distrust from b){steps}
select page_id, host, path, rule,
  coalesce(verdict, case when round(distrust - trust, {DIGITS}) > 0 then 'block' else 'allow' end) as verdict
from p left join s{ROUNDS} using (host)"""
