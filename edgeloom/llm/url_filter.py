"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Outcomes of labelled pages (good or not) are counted by host, registered domain and suffix. From the top
down, the good rate of each level is shrunk towards its parent's: the parent's posterior mean is the mean of
a beta prior whose strength is fitted to the level by moments of the beta-binomial. A host passes if the
lower bound of its posterior good rate reaches a threshold. Hosts without labels inherit.

Defined results: a null url, or one without ``://``, has an empty host and path; repeated pages are judged one
by one; no labels at all leaves the flat prior ``PRIOR``; an empty table gives no rows. Outcomes whose page
is missing or whose ``good`` is null don't count; of several outcomes of a page the best does. A url of any length is
judged whole; other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import storage

#: Good and bad pages that the whole web is taken to have shown before any label: the prior of the root.
PRIOR = (2.0, 1.0)
Z = 1.645
LEAST_GOOD = 0.5
#: Prior strengths that moments may give.
STRENGTH = (2.0, 1000.0)
#: Labels under which countries register names: with a two-letter country they are a suffix, as ``com.mx`` or ``ne.jp``.
CATEGORIES = "ac|co|com|ed|edu|gob|gov|gouv|go|govt|gr|id|ltd|me|mil|ne|net|nom|or|org|plc|sch|school|web"
COUNTRY_SUFFIX = rf"^({CATEGORIES})\.[a-z]{{2}}$"
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("host", "domain", "suffix")


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def with_levels(frame: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Add registered domain and suffix to ``host``; ports don't count.

    ``suffixes(suffix)``: public suffixes of two or three labels besides those that COUNTRY_SUFFIX tells; the longest wins.
    """
    names = F.split(F.regexp_replace("host", ":[0-9]*$", ""), r"\.")

    def tail(n: Column | int) -> Column:
        n = F.least(F.lit(n) if isinstance(n, int) else n, F.size(names))
        return F.array_join(F.slice(names, -n, n), ".")

    size = F.when(tail(2).rlike(COUNTRY_SUFFIX), 2).otherwise(1)
    if suffixes is not None:
        for labels in (2, 3):
            listed = suffixes.where(F.size(F.split("suffix", r"\.")) == labels).select(F.col("suffix").alias(f"_suffix{labels}")).distinct()
            frame = frame.withColumn("_tail", tail(labels)).join(listed, F.col("_tail") == F.col(f"_suffix{labels}"), "left").drop("_tail")
            size = F.when(F.col(f"_suffix{labels}").isNotNull(), labels).otherwise(size)
    frame = frame.withColumns({"suffix": tail(size), "domain": tail(size + 1)})
    return frame.drop("_suffix2", "_suffix3")


def _strength(rows: DataFrame) -> float:
    """How many pages a level's prior is worth: moments of the beta-binomial over ``rows(n, good, above)``."""
    spread, rate = F.col("above") * (1 - F.col("above")), F.col("good") / F.greatest("n", F.lit(1))
    seen = F.sum(F.col("n") * (rate - F.col("above")) * (rate - F.col("above")))
    x = rows.where("n > 0").agg(seen.alias("seen"), F.sum(spread).alias("alone"), F.sum(spread * (F.col("n") - 1)).alias("more")).first()
    rho = (x.seen - x.alone) / x.more if x.more else 0.0
    rho = max(1 / (1 + STRENGTH[1]), min(1 / (1 + STRENGTH[0]), rho))
    return (1 - rho) / rho


def reputations(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior of every host in ``hosts(host, n, good)``: ``host, mean, bound``.

    Hosts with their counts, and each level's means, are stored once; what comes to the driver is four sums a level.
    """
    spark = hosts.sparkSession
    with storage.Scratch(spark, "reputations") as scratch:
        level = scratch.cut(with_levels(hosts, suffixes))
        total = level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
        sums = {"suffix": level.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")),
                "domain": level.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")),
                "host": level}
        above = None
        for i, name in reversed(list(enumerate(LEVELS))):
            if above is None:
                rows = sums[name].withColumn("above", F.lit((total.good + PRIOR[0]) / (total.n + sum(PRIOR))))
            else:
                rows = sums[name].join(above, LEVELS[i + 1])
            rows = scratch.cut(rows)
            strength = _strength(rows)
            mass = F.col("n") + strength
            mean = (F.lit(strength) * F.col("above") + F.col("good")) / mass
            above = rows.select(name, mean.alias("above"), *([mass.alias("mass")] if name == "host" else []))
        bound = F.col("above") - Z * F.sqrt(F.col("above") * (1 - F.col("above")) / (F.col("mass") + 1))
        return storage.cut(above.select("host", F.col("above").alias("mean"), bound.alias("bound")), "reputations")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, suffixes: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, bound`` of every row of ``pages(page_id, url)``.

    ``outcomes(page_id, good)``: good is 1 or 0. ``suffixes(suffix)``: a public suffix list, if there is one. ``rules``: (host, path, verdict), part of the program's
    configuration; the longest rule that fits wins.
    """
    host, path = parts("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    fits = F.lit(None).cast("string")
    verdicts = F.lit(None).cast("string")
    for where, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        hit = ((F.col("host") == where) | F.endswith("host", F.lit(f".{where}"))) & F.startswith("path", F.lit(start))
        fits = F.when(hit, where + start).otherwise(fits)
        verdicts = F.when(hit, verdict).otherwise(verdicts)
    labelled = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.max("good").alias("good"))
    counted = rows.join(labelled, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    known = reputations(counted, suffixes)
    passed = F.when(F.round("bound", 9) >= LEAST_GOOD, "allow").otherwise("block")
    judged = rows.withColumn("rule", fits).withColumn("said", verdicts).join(known, "host")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", passed).alias("verdict"), F.round("bound", 9).alias("bound"))


def _level_sql(name: str, above: str, key: str) -> str:
    return f"""
 {name}_a as (select s.*, a.above from {name}_s s {f'join {above} a using ({key})' if key else f'cross join {above} a'}),
 {name}_m as (select sum(case when n > 0 then n * (good / n - above) * (good / n - above) else 0 end) seen,
   sum(case when n > 0 then above * (1 - above) else 0 end) alone,
   sum(case when n > 0 then above * (1 - above) * (n - 1) else 0 end) more from {name}_a),
 {name}_r as (select greatest({1 / (1 + STRENGTH[1])!r}::double, least({1 / (1 + STRENGTH[0])!r}::double,
   case when more > 0 then (seen - alone) / more else 0 end)) rho from {name}_m),
 {name}_p as (select {name}, ((1 - rho) / rho * above + good) / ((1 - rho) / rho + n) above, (1 - rho) / rho + n mass
   from {name}_a cross join {name}_r)"""


def oracle_sql(rules=RULES) -> str:
    """The same in DuckDB's SQL, with ``labels`` as outcomes."""
    def cases(what: int) -> str:
        order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
        return " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(h + p, v)[what]}'" for h, p, v in order)

    pattern = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    return rf"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{UPPER}', '{LOWER}') host,
   coalesce(regexp_extract(url, '{pattern}', 2), '') path from pages),
 l as (select doc_id page_id, max(case when quality = 1 and toxic = 0 then 1 else 0 end) good from labels
   where doc_id is not null and quality is not null and toxic is not null group by 1),
 h as (select host, count(good)::double n, coalesce(sum(good), 0)::double good from p left join l using (page_id) group by 1),
 k as (select *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') names from h),
 k2 as (select *, case when regexp_matches(array_to_string(names[-2:], '.'), '{COUNTRY_SUFFIX}') then 2 else 1 end size from k),
 host_s as (select host, n, good, array_to_string(names[-size:], '.') suffix, array_to_string(names[-(size + 1):], '.') domain from k2),
 domain_s as (select domain, suffix, sum(n) n, sum(good) good from host_s group by 1, 2),
 suffix_s as (select suffix, sum(n) n, sum(good) good from host_s group by 1),
 root as (select (coalesce(sum(good), 0) + {PRIOR[0]!r}) / (coalesce(sum(n), 0) + {sum(PRIOR)!r}) above from h),
{_level_sql('suffix', 'root', '')},{_level_sql('domain', 'suffix_p', 'suffix')},{_level_sql('host', 'domain_p', 'domain')},
 b as (select host, round(above - {Z} * sqrt(above * (1 - above) / (mass + 1)), 9) bound from host_p)
select page_id, host, path, case {cases(0)} end as rule,
  coalesce(case {cases(1)} end, case when bound >= {LEAST_GOOD} then 'allow' else 'block' end) as verdict, bound
from p join b using (host)"""
