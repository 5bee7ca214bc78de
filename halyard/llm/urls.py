"""URL filters: rules, and for URLs that no rule decides a character language-model ratio, all in DataFrame functions.

Two variable-order Markov models with Witten-Bell smoothing (contexts of 3 characters down to none) are counted over the distinct
URLs that the rules allow and block. A URL's score is the mean over its characters of log p(allowed) - log p(blocked). The threshold
is calibrated on a fifth of the decided URLs, which the counts leave out: the edge with the best true minus false acceptance rate.

URLs are written in 31 symbols (a-z, one digit, `.`, `/`, `-`, one for all else) after 3 start marks, so there are at most
31 * 32**3 four-character grams, whatever the input; their weights are what is broadcast (some 60 MB at the very most).

Defined cases: a null or empty URL has no score and is allowed by the method; with no allowed or no blocked URL to calibrate on the
threshold is 0; of rules of one length the first in alphabetical order wins; repeated rows give repeated rows; an empty table gives
an empty table; other columns of the pages stay unless they are named like a result, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import common
from halyard.names import free

ORDER, SYMBOLS, EDGES = 3, 31, 20
PAD = "^" * ORDER
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of md5's first hex digit; the others are for calibration.
TRAIN_BELOW = "d"
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        own, _, rest = rule.partition("/")
        found = F.when(((host == own) | host.endswith("." + own)) & path.startswith("/" + rest), F.lit(rule)).otherwise(found)
    return found


def grams_of(url: Column) -> Column:
    """Every character with the ORDER symbols before it."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(url, UPPER, LOWER), "[0-9]", "0"), "[^a-z0./-]", "~")
    return F.regexp_extract_all(F.concat(F.lit(PAD), plain), F.lit(f"(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def weights(urls: DataFrame) -> DataFrame:
    """gram, weight. urls: url, label (1 allowed, 0 blocked, else null; null also where it isn't to be counted)."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    grams = urls.select("label", F.explode(grams_of(F.col("url"))).alias("gram")).groupBy("gram").agg(one(F.col("label") == 1).alias("yes"), one(F.col("label") == 0).alias("no"))
    grams = common.cut(grams, "url-grams")
    out = grams.withColumns({"p_yes": F.lit(1.0 / SYMBOLS), "p_no": F.lit(1.0 / SYMBOLS)})
    for k in range(ORDER + 1):
        key, context = F.substring("gram", ORDER + 1 - k, k + 1), F.substring("gram", ORDER + 1 - k, k)
        count = grams.groupBy(key.alias("key")).agg(F.sum("yes").alias("c_yes"), F.sum("no").alias("c_no"))
        after = count.groupBy(F.substring("key", 1, k).alias("context")).agg(*(f(x).alias(n) for x in ("yes", "no") for n, f in ((f"n_{x}", lambda x: F.sum(f"c_{x}")), (f"t_{x}", lambda x: F.count_if(F.col(f"c_{x}") > 0)))))
        out = out.withColumns({"key": key, "context": context}).join(count, "key").join(after, "context")
        for x in ("yes", "no"):
            out = out.withColumn(f"p_{x}", F.when(F.col(f"n_{x}") > 0, (F.col(f"c_{x}") + F.col(f"t_{x}") * F.col(f"p_{x}")) / (F.col(f"n_{x}") + F.col(f"t_{x}"))).otherwise(F.col(f"p_{x}")))
        out = out.select("gram", "p_yes", "p_no")
    return out.select("gram", (F.log("p_yes") - F.log("p_no")).alias("weight"))


def threshold(scored: DataFrame) -> float:
    """scored: label, score. Counts of at most 10 * EDGES + 1 bins reach the driver."""
    most = 5 * EDGES
    bins = scored.groupBy(F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.col("score") * EDGES))).alias("bin")).agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no")).collect()
    yes, no = sum(r.yes for r in bins), sum(r.no for r in bins)
    if not yes or not no:
        return 0.0
    gain = {e: sum(r.yes for r in bins if r.bin >= e) * no - sum(r.no for r in bins if r.bin >= e) * yes for e in range(-most, most + 1)}
    return min(gain, key=lambda e: (-gain[e], abs(e), e)) / EDGES


def judge(pages: DataFrame, rules: dict[str, str] | None = None, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, score and verdict. score: only where no rule fits."""
    rules = RULES if rules is None else rules
    own = ["host", "path", "rule", "score", "verdict"]
    pages = pages.drop(*(c for c in pages.columns if c in own and c != url_col))
    url = F.col("url")
    named = pages.select(F.col(url_col).cast("string").alias("url")).where("url <> ''").groupBy("url").agg(F.count("*").alias("n"))
    named = named.withColumn("rule", rule_of(host_of(url), path_of(url), rules))
    verdict = F.lit(None).cast("string")
    for r, v in rules.items():
        verdict = F.when(F.col("rule") == r, F.lit(v)).otherwise(verdict)
    named = common.cut(named.select("url", F.when(verdict == "allow", 1).when(verdict == "block", 0).alias("label"), (F.md5("url") < TRAIN_BELOW).alias("train")), "urls")
    weight = common.cut(weights(named.select("url", F.when(F.col("train"), F.col("label")).alias("label"))), "url-weights")
    scored = named.where("label is null or not train").withColumn("gram", F.explode(grams_of(url))).join(F.broadcast(weight), "gram").groupBy("url", "label").agg(F.round(F.avg("weight"), 9).alias("score"))
    scored = common.cut(scored, "url-scores")
    least = threshold(scored.where("label is not null"))
    asked, decided = free("_url", pages), free("_decided", pages)
    score = scored.where("label is null").select(F.col("url").alias(asked), "score")
    u = F.col(url_col).cast("string")
    out = pages.withColumns({"host": host_of(u), "path": path_of(u)})
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn(decided, verdict)
    out = out.join(score, F.when(F.col(decided).isNull(), F.nullif(u, F.lit(""))) == F.col(asked), "left").drop(asked)
    return out.withColumn("verdict", F.coalesce(decided, F.when(F.col("score") < least, "block").otherwise("allow"))).drop(decided)


def op1_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same in DuckDB's SQL."""
    rules = ", ".join(f"('{r}', '{v}')" for r, v in RULES.items())
    steps = []
    for k in range(ORDER + 1):
        last = "gram" if not k else f"s{k - 1}.gram"
        before = "from grams" if not k else f"from s{k - 1} join grams using (gram)"
        p = {x: f"{1.0 / SYMBOLS!r}" if not k else f"p_{x}" for x in ("yes", "no")}
        at = f"substr(gram, {ORDER + 1 - k}, {k + 1})"
        steps.append(
            f"c{k} as (select {at} as key, sum(yes) as c_yes, sum(no) as c_no from grams group by 1), "
            f"a{k} as (select substr(key, 1, {k}) as context, sum(c_yes) as n_yes, sum(c_no) as n_no, count(*) filter (c_yes > 0) as t_yes, count(*) filter (c_no > 0) as t_no from c{k} group by 1), "
            f"s{k} as (select {last} as gram, "
            + ", ".join(f"case when n_{x} > 0 then (c_{x} + t_{x} * {p[x]}::double)::double / (n_{x} + t_{x}) else {p[x]}::double end as p_{x}" for x in ("yes", "no"))
            + f" {before} join c{k} on c{k}.key = {at.replace('gram', last)} join a{k} on a{k}.context = substr({last}, {ORDER + 1 - k}, {k}))"
        )
    return f"""
with rules(rule, v) as (values {rules}),
r as (select rule, v, split_part(rule, '/', 1) as rh, substr(rule, strpos(rule, '/')) as rp from rules),
p as (select page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
hp as (select distinct host, path from p),
fit as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v from hp join r
  on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all),
u as (select distinct url, case v when 'allow' then 1 when 'block' then 0 end as label, md5(url) < '{TRAIN_BELOW}' as train
  from p left join fit using (host, path) where url <> ''),
plain as (select *, '{PAD}' || regexp_replace(regexp_replace(translate(url, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '[^a-z0./-]', '~', 'g') as s from u),
g as (select url, label, train, substr(s, i, {ORDER + 1}) as gram from (select *, unnest(range(1, length(s) - {ORDER} + 1)) as i from plain)),
grams as (select gram, count(*) filter (train and label = 1) as yes, count(*) filter (train and label = 0) as no from g group by 1),
{", ".join(steps)},
w as (select gram, ln(p_yes) - ln(p_no) as weight from s{ORDER}),
scored as (select url, label, round(avg(weight), 9) as score from g join w using (gram) where label is null or not train group by all),
bins as (select greatest({-5 * EDGES}, least({5 * EDGES}, floor(score * {EDGES}))) as bin, count(*) filter (label = 1) as yes, count(*) filter (label = 0) as no
  from scored where label is not null group by 1),
total as (select sum(yes) as yes, sum(no) as no from bins),
edges as (select unnest(range({-5 * EDGES}, {5 * EDGES + 1})) as e),
gain as (select e, coalesce(sum(b.yes), 0) * any_value(t.no) - coalesce(sum(b.no), 0) * any_value(t.yes) as gain from edges cross join total t left join bins b on b.bin >= e where t.yes > 0 and t.no > 0 group by e),
least_score as (select coalesce((select e / {EDGES}.0 from gain order by gain desc, abs(e), e limit 1), 0) as least)
select page_id, host, path, rule, case when v is not null then v when score < (select least from least_score) then 'block' else 'allow' end as verdict
from p left join fit using (host, path) left join (select url, score from scored where label is null) using (url)
"""


SQL = _sql()
