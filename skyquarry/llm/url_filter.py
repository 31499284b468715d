"""URL filters: rules on hosts and paths, and for other URLs the ratio of two character language models.

URLs that a rule allows or blocks are the examples of accepted and rejected ones. For each side, counts of the character
n-grams up to ORDER of host and path give a variable-order Markov model with Witten-Bell smoothing: the probability of a
character mixes the estimates after 0 to ORDER - 1 characters, each weighed by how often and how variously its context
was seen. A URL's score is the difference of the two log likelihoods divided by its length. One example in HOLD is held
out of the counts; the threshold is where held-out examples of both sides are told apart best. DataFrame functions only.

Characters are mapped to an alphabet of 32 symbols, so there are at most 32 ** ORDER n-grams of the highest order, a million:
the models have that bound whatever the number of URLs, and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, table, with_uid, written

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4
HOLD = 5
#: Steps of the scale on which the threshold is sought.
BINS, REACH = 400, 4.0
SIDES = ("allow", "block")


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty if there is none."""
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer one is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def symbols(host: Column, path: Column) -> Column:
    """Host and path in 32 symbols: a-z, 0 for digits, ./-^ and * for the rest; ^ begins and $ ends."""
    plain = F.regexp_replace(F.regexp_replace(lower_az(F.concat(host, path)), "[0-9]", "0"), r"[^a-z0./\-]", "*")
    return F.concat(F.lit("^"), plain, F.lit("$"))


def grams(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row for each character after the first: gram is it with up to ORDER - 1 characters before it."""
    at = F.explode(F.sequence(F.lit(2), F.length(text))).alias("at_")
    df = df.select(*keep, text, at)
    begin = F.greatest(F.lit(1), F.col("at_") - (ORDER - 1))
    return df.select(*keep, F.col(text).substr(begin, F.col("at_") - begin + 1).alias("gram"))


def counts(examples: DataFrame, text: str) -> DataFrame:
    """(gram of ORDER or fewer characters, allow_, block_): counts on both sides, for each order and its contexts."""
    full = grams(examples, text, ["verdict"]).groupBy("gram").agg(*(F.count_if(F.col("verdict") == s).alias(s) for s in SIDES))
    # shorter n-grams are the ends of longer ones
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.col("gram").substr(-n, n)))
    return full.select(ends.alias("gram"), *SIDES).groupBy("gram").agg(*(F.sum(s).alias(s) for s in SIDES))


def models(n: DataFrame) -> DataFrame:
    """(gram, ratio): log10 of the smoothed probability of the gram's last character, allowed less blocked."""
    size = F.length("gram")
    context = n.groupBy(F.substring("gram", 1, size - 1).alias("context")).agg(
        *(F.sum(s).alias(f"{s}_all") for s in SIDES), *(F.count_if(F.col(s) > 0).alias(f"{s}_kinds") for s in SIDES)
    )
    one = n.withColumn("context", F.substring("gram", 1, size - 1)).join(context, "context").withColumn("short", F.col("gram").substr(F.lit(2), F.length("gram") - 1))
    # from the shortest to the longest; a context not seen on a side leaves the shorter estimate as it is
    done = None
    for k in range(1, ORDER + 1):
        part = one.filter(F.length("gram") == k)
        if done is None:
            below = {s: F.lit(1 / 32) for s in SIDES}
        else:
            part = part.join(done.select(F.col("gram").alias("short"), *(F.col(f"p_{s}").alias(f"q_{s}") for s in SIDES)), "short")
            below = {s: F.col(f"q_{s}") for s in SIDES}
        part = part.select("gram", *(F.when(F.col(f"{s}_all") == 0, below[s]).otherwise((F.col(s) + F.col(f"{s}_kinds") * below[s]) / (F.col(f"{s}_all") + F.col(f"{s}_kinds"))).alias(f"p_{s}") for s in SIDES))
        done = part if done is None else done.unionByName(part)
    return done.select("gram", F.log10(F.col("p_allow") / F.col("p_block")).alias("ratio"))


def scores(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """(uid, score): mean over characters of the ratio of the longest known end of its n-gram."""
    longest = None
    df = grams(rows, "seen", ["uid"])
    for k in range(ORDER, 0, -1):
        known = F.broadcast(ratios.filter(F.length("gram") == k).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}")))
        df = df.join(known, F.when(F.length("gram") >= k, F.col("gram").substr(F.lit(-k), F.lit(k))) == F.col(f"g{k}"), "left").drop(f"g{k}")
        longest = F.col(f"r{k}") if longest is None else F.coalesce(longest, F.col(f"r{k}"))
    return df.groupBy("uid").agg(F.round(F.avg(F.coalesce(longest, F.lit(0.0))), 6).alias("score"))


def threshold(scored: DataFrame) -> float:
    """Of held-out examples, the edge of BINS bins with the best mean share told right; 0 if a side has none."""
    bin_ = F.least(F.greatest(F.floor((F.col("score") + REACH) / (2 * REACH) * BINS), F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(bin_.alias("bin")).agg(*(F.count_if(F.col("verdict") == s).alias(s) for s in SIDES)).collect()  # BINS rows at most
    by = {int(r["bin"]): (r["allow"], r["block"]) for r in rows}
    good, bad = (sum(x[i] for x in by.values()) for i in (0, 1))
    if not good or not bad:
        return 0.0
    shares, allowed, blocked = [], good, 0
    for b in range(BINS + 1):  # allowed at or above edge b, blocked below
        at = b * 2 * REACH / BINS - REACH
        shares.append((-round(allowed / good + blocked / bad, 9), abs(at), at))
        allowed, blocked = allowed - by.get(b, (0, 0))[0], blocked + by.get(b, (0, 0))[1]
    return min(shares)[2]  # of equal ones the nearest to 0


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides): one row for each row of pages.

    A null URL, or one without ://, has empty host and path and is judged by the model as an empty text. Without examples
    of both sides, URLs without a rule are allowed. URLs count whole, however long; repeated rows are all examples and get
    equal verdicts; a score at the threshold is allowed, and of rules of one length the later one in RULES decides.
    Only id and URL are read, so other columns may have any names; an empty table gives an empty result.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = with_uid(pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = written(rows.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("seen", symbols(F.col("host"), F.col("path"))), "url-rows")

    examples = rows.filter(F.col("verdict").isNotNull()).withColumn("held", F.conv(F.substring(F.md5("seen"), 1, 4), 16, 10).cast("long") % HOLD == 0)
    there = examples.agg(*(F.count_if((F.col("verdict") == s) & ~F.col("held")).alias(s) for s in SIDES)).first()
    if not all(there):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    ratios = written(models(counts(examples.filter(~F.col("held")), "seen")), "url-models")
    asked = rows.filter(F.col("verdict").isNull()).unionByName(examples.filter("held").drop("held"))
    scored = written(scores(asked, ratios), "url-scores")
    edge = threshold(examples.filter("held").select("uid", "verdict").join(scored, "uid"))
    says = F.coalesce("verdict", F.when(F.col("score") >= edge, "allow").otherwise("block"))
    return rows.join(scored, "uid", "left").select("page_id", "host", "path", "rule", says.alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))


def op10_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same in DuckDB's SQL."""
    low = f"'{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}'"
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda i: " ".join(f"WHEN {fits(h, p)} THEN '{(says, h + p)[i]}'" for says, h, p in longest)
    chance = lambda s, below: f"CASE WHEN coalesce(c.{s}_all, 0) = 0 THEN {below} ELSE (n.{s} + c.{s}_kinds * {below}) / (c.{s}_all + c.{s}_kinds)::DOUBLE END AS p_{s}"
    levels = [f"m1 AS (SELECT n.gram, {', '.join(chance(s, '(1 / 32.0::DOUBLE)') for s in SIDES)} FROM n JOIN cx c ON c.context = '' WHERE length(n.gram) = 1)"]
    for k in range(2, ORDER + 1):
        levels.append(f"m{k} AS (SELECT n.gram, {', '.join(chance(s, f'b.p_{s}') for s in SIDES)} FROM n JOIN cx c ON c.context = left(n.gram, {k - 1}) AND c.k = {k} JOIN m{k - 1} b ON b.gram = right(n.gram, {k - 1}) WHERE length(n.gram) = {k})")
    levels[0] = levels[0].replace("c.context = ''", "c.context = '' AND c.k = 1")
    union = " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, ORDER + 1))
    looks = " ".join(f"LEFT JOIN ra r{k} ON length(g.gram) >= {k} AND r{k}.gram = right(g.gram, {k})" for k in range(ORDER, 0, -1))
    grams = lambda of, keep: f"SELECT {keep}, substr(seen, greatest(1, at_ - {ORDER - 1}), at_ - greatest(1, at_ - {ORDER - 1}) + 1) AS gram FROM (SELECT *, unnest(range(2, length(seen) + 1)) AS at_ FROM {of})"
    return rf"""
WITH u AS (SELECT row_number() OVER () AS uid, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {low}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT *, CASE {case(1)} END AS rule, CASE {case(0)} END AS verdict, '^' || regexp_replace(regexp_replace(translate(host || path, {low}), '[0-9]', '0', 'g'), '[^a-z0./-]', '*', 'g') || '$' AS seen FROM u),
x AS (SELECT *, ('0x' || substr(md5(seen), 1, 4))::BIGINT % {HOLD} = 0 AS held FROM v WHERE verdict IS NOT NULL),
fu AS (SELECT gram, {', '.join(f"count(*) FILTER (verdict = '{s}') AS {s}" for s in SIDES)} FROM ({grams('(SELECT * FROM x WHERE NOT held)', 'verdict')}) GROUP BY gram),
n AS (SELECT gram, {', '.join(f'sum({s}) AS {s}' for s in SIDES)} FROM (SELECT {', '.join(SIDES)}, right(gram, k) AS gram FROM fu, (SELECT unnest(range(1, {ORDER + 1})) AS k) WHERE k <= length(gram)) GROUP BY gram),
cx AS (SELECT left(gram, length(gram) - 1) AS context, length(gram) AS k, {', '.join(f'sum({s}) AS {s}_all, count(*) FILTER ({s} > 0) AS {s}_kinds' for s in SIDES)} FROM n GROUP BY 1, 2),
{(','+chr(10)).join(levels)},
ra AS (SELECT gram, log10(p_allow / p_block) AS ratio FROM ({union})),
q AS (SELECT uid, seen FROM v WHERE verdict IS NULL UNION ALL SELECT uid, seen FROM x WHERE held),
g AS ({grams('q', 'uid')}),
sc AS (SELECT g.uid, round(avg(coalesce({', '.join(f'r{k}.ratio' for k in range(ORDER, 0, -1))}, 0)), 6) AS score FROM g {looks} GROUP BY g.uid),
bi AS (SELECT least(greatest(floor((score + {REACH}) / {2 * REACH} * {BINS}), 0), {BINS - 1}) AS bin, verdict FROM x JOIN sc USING (uid) WHERE held),
ed AS (SELECT e, e * {2 * REACH}::DOUBLE / {BINS} - {REACH} AS at_, (SELECT count(*) FROM bi WHERE verdict = 'allow' AND bin >= e) / (SELECT count(*) FROM bi WHERE verdict = 'allow')::DOUBLE + (SELECT count(*) FROM bi WHERE verdict = 'block' AND bin < e) / (SELECT count(*) FROM bi WHERE verdict = 'block')::DOUBLE AS share FROM (SELECT unnest(range(0, {BINS + 1})) AS e)),
th AS (SELECT arg_min(at_, (-round(share, 9), abs(at_), at_)) AS edge FROM ed)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= edge THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN score END AS score FROM v LEFT JOIN sc USING (uid), th"""


OP10_SQL = _sql()
