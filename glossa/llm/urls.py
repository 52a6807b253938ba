"""URL filter: fixed rules first, then the empirical-Bayes reputation of the host.

Labelled pages give each host its count of bad outcomes. A host's rate is shrunk to its
registered domain's, that to its public suffix's, that to the overall rate, each by a
beta-binomial prior whose strength is estimated from all groups of the level. A host is
blocked if the lower quantile of its Beta posterior exceeds a limit.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.shared import Scratch

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Rules up to which each is a condition of its own; more are joined by the host's suffixes.
FEW_RULES = 40
MAX_BAD, Z = 0.3, 1.2816
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: What stands in for missing evidence: the correlation within groups, as if seen in so many further pages, and the bad rate.
PRIOR_RHO, PRIOR_PAGES = 0.05, 20
PRIOR_BAD, PRIOR_LABELS = 0.1, 10
#: Public suffixes of several labels, in the public list's notation: "*.x" any label under x, "!y.x" not so for y. One label is always one.
SUFFIXES = tuple(
    "co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk sch.uk com.au net.au org.au edu.au gov.au co.nz net.nz org.nz ac.nz govt.nz co.jp ne.jp or.jp ac.jp go.jp com.br net.br org.br gov.br com.cn net.cn org.cn "
    "gov.cn edu.cn com.tr org.tr gov.tr com.mx org.mx gob.mx com.ar org.ar gob.ar co.in net.in org.in gov.in ac.in co.kr or.kr go.kr ac.kr co.za org.za gov.za com.sg edu.sg com.hk org.hk com.tw org.tw com.my "
    "com.ph com.vn co.id or.id co.th or.th co.il org.il com.ua com.pl org.pl co.at or.at com.es org.es com.fr asso.fr gouv.fr com.pt com.co com.pe com.ve com.eg com.sa com.pk com.ng co.ke "
    "github.io gitlab.io blogspot.com wordpress.com tumblr.com herokuapp.com netlify.app vercel.app pages.dev web.app *.ck !www.ck *.bd *.er *.fk *.jm *.kh *.mm *.np *.pg".split()
)
_ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*)$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?" or "#"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none does."""
    name = action = F.lit(None).cast("string")
    for verb, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        name, action = F.when(fits, rule).otherwise(name), F.when(fits, verb).otherwise(action)
    return name, action


def with_rule(parsed: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """parsed (with host, path) with rule and action: of any number of rules."""
    if len(rules) <= FEW_RULES:
        rule, action = matched_rule(F.col("host"), F.col("path"), rules)
        return parsed.withColumns({"rule": rule, "action": action})
    table = parsed.sparkSession.createDataFrame([(r, v, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules], "rule string, action string, of string, start string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = parsed.select("host", "path").distinct().withColumn("of", F.explode(ends)).join(table, "of").where(F.col("path").startswith(F.col("start")))
    longest = each.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "action")).alias("r")).select("host", "path", "r.rule", "r.action")
    return parsed.join(longest, ["host", "path"], "left")


def site_of(host: Column) -> Column:
    """The host without user, port and a last dot: what has a reputation."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    return F.regexp_replace(bare, r"\.$", "")


def domain_and_suffix(site: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain (the public suffix and one label more) and public suffix. Addresses are domains of their own, under the suffix ""."""
    labels = F.split(site, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n if isinstance(n, Column) else F.lit(n)), ".")
    plain = [s for s in suffixes if s[0] not in "*!"]
    wild, never = [s[2:] for s in suffixes if s[0] == "*"], [s[1:] for s in suffixes if s[0] == "!"]
    n = F.lit(1)
    for k in range(2, 2 + max([s.count(".") for s in suffixes], default=0)):
        fits = last(k).isin([s for s in plain if s.count(".") == k - 1]) | last(k - 1).isin([s for s in wild if s.count(".") == k - 2]) & ~last(k).isin(never)
        n = F.when((F.size(labels) >= k) & fits, k).otherwise(n)
    address = site.rlike(_ADDRESS)
    return F.when(address, site).otherwise(last(n + 1)), F.when(address, "").otherwise(last(n))


def _rho(groups: DataFrame) -> float:
    """Correlation of outcomes in a group, from n, k and the prior mean m of all its groups: by moments, with PRIOR_PAGES of PRIOR_RHO."""
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    spread = m * (1 - m)
    found = groups.where("n > 0").agg(F.sum((k / n - m) * (k / n - m) * n - spread), F.sum((n - 1) * spread), F.sum(n * spread) / F.sum(n)).first()
    if not found[2]:
        return PRIOR_RHO
    return round(min(MOST_RHO, max(LEAST_RHO, (found[0] + PRIOR_RHO * PRIOR_PAGES * found[2]) / (found[1] + PRIOR_PAGES * found[2]))), 9)


def _shrunk(k: Column, n: Column, m: Column, rho: float) -> Column:
    strength = 1 / rho - 1
    return F.round((k + strength * m) / (n + strength), 12)


def beta_quantile(a: Column, b: Column, z: float = Z) -> Column:
    """The quantile of Beta(a, b) that the standard normal has at -z, by Paulson's cube-root approximation of the F distribution.

    Within 0.02 of the exact one; b counts as 0.5 at least, below which the approximation has no such quantile.
    """
    b = F.greatest(b, F.lit(0.5))
    p, q = 1 / (9 * b), 1 / (9 * a)
    u = ((1 - p) * (1 - q) - z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - q) * (1 - q) + q * (1 - p) * (1 - p) - z * z * p * q))) / ((1 - p) * (1 - p) - z * z * p)
    f = F.pow(F.greatest(u, F.lit(0.0)), F.lit(3.0))
    return a * f / (b + a * f)


def host_reputation(pages: DataFrame, labels: DataFrame, scratch: Scratch, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """site, n_labelled, n_bad, bad_bound: one row per site_of() the hosts of `pages` (page_id, host).

    labels: doc_id, quality, toxic. The label of a page is that with its id; it is bad if
    quality is 0 or toxic is 1, and rows without both values don't count. Repeated labels
    count each. Sites without labels get the posterior of their prior alone; without any
    label at all that is PRIOR_BAD.
    """
    outcome = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.count("*").alias("n"), F.sum(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("k")
    )
    domain, suffix = domain_and_suffix(F.col("site"), suffixes)
    hosts = scratch.save(
        pages.select("page_id", site_of(F.col("host")).alias("site")).join(outcome, "page_id", "left").groupBy("site")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
        .withColumns({"domain": domain, "suffix": suffix})
    )
    totals = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    overall = round((totals[1] + PRIOR_BAD * PRIOR_LABELS) / (totals[0] + PRIOR_LABELS), 12)
    top = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(overall))
    top = top.select("suffix", _shrunk(F.col("k"), F.col("n"), F.col("m"), _rho(top)).alias("m"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(top, "suffix")
    domains = scratch.save(domains.select("domain", "suffix", _shrunk(F.col("k"), F.col("n"), F.col("m"), _rho(domains)).alias("m")))
    rated = hosts.join(domains, ["domain", "suffix"])
    strength = 1 / _rho(rated) - 1
    a, b = F.col("k") + strength * F.col("m"), F.col("n") - F.col("k") + strength * (1 - F.col("m"))
    return rated.select("site", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), F.round(beta_quantile(a, b), 9).alias("bad_bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", max_bad: float = MAX_BAD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_bound: one row per input row.

    Null urls and urls without "://" have an empty host and path; the empty host has a
    reputation like any other. Without any label no host is bad. Rows that repeat an id
    count each; null ids have no label. Of rules of the same length the last in order of
    their text wins. Extra columns are ignored, and no pages give no rows.
    """
    scratch = Scratch(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = host_reputation(parsed, labels, scratch, suffixes)
    own = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    judged = with_rule(parsed, rules).withColumn("site", site_of(F.col("host"))).join(known.select("site", "bad_bound"), "site")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", own).alias("verdict"), "bad_bound")


def op8_host_reputation(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge_urls(pages, labels).drop("bad_bound")


def _rho_sql(table: str) -> str:
    return f"""(select round(case when coalesce(sum(n * m * (1 - m)), 0) = 0 then {PRIOR_RHO}
  else least({MOST_RHO}, greatest({LEAST_RHO}, (sum((k / n - m) * (k / n - m) * n - m * (1 - m)) + {PRIOR_RHO * PRIOR_PAGES} * sum(n * m * (1 - m)) / sum(n))
    / (sum((n - 1) * m * (1 - m)) + {PRIOR_PAGES} * sum(n * m * (1 - m)) / sum(n)))) end, 9)
  from {table} where n > 0)"""


_PLAIN = ", ".join(f"'{s}'" for s in SUFFIXES if s[0] not in "*!")
_WILD = ", ".join(f"'{s[2:]}'" for s in SUFFIXES if s[0] == "*")
_NEVER = ", ".join(f"'{s[1:]}'" for s in SUFFIXES if s[0] == "!")

OP8_SQL = rf"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parsed as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') as path
  from cut),
sited as (select *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', ''), '\.$', '') as site from parsed),
outcome as (
  select doc_id as page_id, count(*) as n, sum(case when quality = 0 or toxic = 1 then 1 else 0 end) as k
  from labels where quality is not null or toxic is not null group by doc_id),
tail as (
  select site, n, k, regexp_extract(site, '[^.]*$') as one, regexp_extract(site, '[^.]*\.[^.]*$') as two, regexp_matches(site, '^(\d{{1,3}}(\.\d{{1,3}}){{3}}$|\[)') as address
  from (select site, cast(coalesce(sum(n), 0) as double) as n, cast(coalesce(sum(k), 0) as double) as k from sited left join outcome using (page_id) group by site)),
cuts as (select *, case when two <> '' and (two in ({_PLAIN}) or one in ({_WILD}) and two not in ({_NEVER})) then two else one end as suffix0 from tail),
hosts as (
  select site, n, k, case when address then '' else suffix0 end as suffix,
    case when address or site = suffix0 then site else regexp_extract(left(site, length(site) - length(suffix0) - 1), '[^.]*$') || '.' || suffix0 end as domain
  from cuts),
suffix0 as (
  select suffix, sum(n) as n, sum(k) as k, (select round((sum(k) + {PRIOR_BAD * PRIOR_LABELS}) / (sum(n) + {PRIOR_LABELS}), 12) from hosts) as m
  from hosts group by suffix),
suffix_rho as (select {_rho_sql('suffix0')} as rho),
suffix1 as (select suffix, round((k + (1 / rho - 1) * m) / (n + (1 / rho - 1)), 12) as m from suffix0, suffix_rho),
domain0 as (
  select domain, suffix, n, k, m from (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by domain, suffix) join suffix1 using (suffix)),
domain_rho as (select {_rho_sql('domain0')} as rho),
domain1 as (select domain, suffix, round((k + (1 / rho - 1) * m) / (n + (1 / rho - 1)), 12) as m from domain0, domain_rho),
rated as (select site, n, k, m from hosts join domain1 using (domain, suffix)),
host_rho as (select {_rho_sql('rated')} as rho),
beta as (select site, k + (1 / rho - 1) * m as a, greatest(0.5, n - k + (1 / rho - 1) * (1 - m)) as b from rated, host_rho),
cube as (select site, a, b, 1 - 1 / (9 * b) as x, 1 - 1 / (9 * a) as y from beta),
root as (
  select site, a, b, greatest(0.0, (x * y - {Z} * sqrt(greatest(0.0, (1 - x) * y * y + (1 - y) * x * x - {Z} * {Z} * (1 - x) * (1 - y)))) / (x * x - {Z} * {Z} * (1 - x))) as u from cube),
bounds as (select site, round(a * u * u * u / (b + a * u * u * u), 9) as bad_bound from root),
rules(action, rule, h, p) as (values
  {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
fits as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
  from (select distinct page_id, host, path from parsed) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by page_id)
select page_id, host, path, rule, coalesce(action, case when bad_bound > {MAX_BAD} then 'block' else 'allow' end) as verdict
from sited join bounds using (site) left join fits using (page_id)
"""
