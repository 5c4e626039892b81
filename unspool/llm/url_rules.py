"""URL filtering by association rules, in DataFrame operations and Spark's own FP-growth only.

Labelled URLs become sets of tokens with their label; FP-growth finds the combinations that are
frequent among them, and those that imply a label with enough confidence are kept as rules. A
rule is filed in an inverted index under its rarest token, so a URL meets only the rules that
share that token, and of the rules whose tokens it all has the most confident decides (ties: the
larger support, then the longer combination, then the token order). A URL that no rule matches gets
the commoner label of the training URLs, or `allow` where there is none.

Host and path: the host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z
lowered; the path goes from there up to `?`, `#` or the end. A null URL or one without `://` has
both empty, and no tokens. Fixed lists come first: a rule (host, path) fits the host and all its
subdomains where the path starts with the rule's; the longest decides. Repeated rows are judged
alike; an empty table gives an empty result; without labelled URLs there are no mined rules.
Columns beside `url` pass through; those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unspool.llm.common import lower_ascii, materialize

#: (verdict, host, path) of the fixed lists.
LISTS = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_LABEL = "verdict="
#: Rules that are sent to every executor at most; more meet the URLs in a shuffled join.
BROADCAST_RULES = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, lists: tuple = LISTS) -> tuple[Column, Column]:
    """The fixed rule that fits (host and path as one string) and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, own_host, own_path in sorted(lists, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule, verdict = F.when(fits, own_host + own_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """The distinct tokens of a URL: ending, name parts and depth of the host, words of the path, what follows it."""
    parts = F.split(host, "\\.")
    names = F.transform(F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, "-"))), lambda p: p != ""), lambda p: F.concat(F.lit("host:"), p))
    steps = F.filter(F.split(path, "/"), lambda p: p != "")
    words = F.transform(steps, lambda p: F.concat(F.lit("path:"), F.regexp_replace(lower_ascii(p), "[0-9]+", "0")))
    first_digit = F.transform(F.filter(steps, lambda p: p.rlike("^[0-9]")), lambda p: F.concat(F.lit("digit:"), F.substring(p, 1, 1)))
    query = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([A-Za-z_]+)="), F.lit(1)), lambda q: F.concat(F.lit("query:"), q))
    ending = F.concat(F.lit("ending:"), F.element_at(parts, -1))
    some = F.array_distinct(F.concat(F.array(ending, F.concat(F.lit("depth:"), F.size(steps).cast("string"))), names, words, first_digit, query))
    return F.when(host != "", some).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, least_rows: int = 25, least_share: float = 0.002, confidence: float = 0.8) -> tuple[DataFrame, str]:
    """Rules (tokens, verdict, confidence, support, anchor) from labelled (tokens, verdict), and the commoner label.

    A combination counts with least_rows rows and least_share of all rows; a rule with `confidence`
    or more. Of rules with the same verdict, one that adds tokens to another without more confidence
    is pruned. What is frequent is bounded by least_share, however many rows there are.
    """
    spark = labelled.sparkSession
    counts = {r["verdict"]: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    n = sum(counts.values())
    common = max(sorted(counts), key=lambda v: counts[v]) if counts else "allow"
    schema = "tokens array<string>, verdict string, confidence double, support double, anchor string, rule_id long"
    if n == 0:
        return spark.createDataFrame([], schema), common
    sets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(least_share, least_rows / n)), minConfidence=confidence).fit(sets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith(_LABEL) & ~F.exists("antecedent", lambda t: t.startswith(_LABEL)))
    rules = rules.select(F.sort_array("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(_LABEL) + 1, 100).alias("verdict"), "confidence", "support")
    # Keys and frequencies of single tokens, for the anchors.
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = materialize(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")), "url-rules")
    each = rules.select("rule_id", F.explode("tokens").alias("token")).join(single, "token")
    anchor = each.groupBy("rule_id").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    # The rule that lacks one token and is as confident makes a rule needless.
    shorter = rules.select(F.col("rule_id"), "verdict", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("less"))
    needless = shorter.alias("l").join(rules.alias("s"), (F.col("l.less") == F.col("s.tokens")) & (F.col("l.verdict") == F.col("s.verdict")) & (F.col("s.confidence") >= F.col("l.confidence"))).select(F.col("l.rule_id").alias("rule_id")).distinct()
    return rules.join(needless, "rule_id", "left_anti").join(anchor, "rule_id").select(*[f.split()[0] for f in schema.split(", ")]), common


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and the verdict of the best rule, for the URLs of `urls` (url, tokens; each once) that a rule matches."""
    rules = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    met = urls.select("url", "tokens", F.explode("tokens").alias("anchor")).join(rules.withColumnRenamed("tokens", "needed"), "anchor")
    met = met.where(F.forall("needed", lambda t: F.array_contains("tokens", t)))
    best = F.struct("confidence", "support", F.size("needed").alias("n"), "needed", "verdict")
    return met.groupBy("url").agg(F.max(best).alias("best")).select("url", F.col("best.verdict").alias("mined"), F.col("best.needed").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def labels_of_pages(pages: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(url, verdict) for judge() from marks of documents (doc_id and a 0/1 label): a page has the mark of the document of its number, 1 allows."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(label).alias("mark"))
    return pages.where("url is not null").join(marks, "page_id").select("url", F.when(F.col("mark") == 1, "allow").otherwise("block").alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame | None = None, lists: tuple = LISTS) -> DataFrame:
    """pages with host, path, rule, verdict, and the mined rule where that decided.

    labels: (url, verdict) to learn from; by default the URLs that the fixed lists judge.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), lists)
    parsed = pages.withColumns({"host": host, "path": path}).withColumn("rule", rule).withColumn("listed", verdict)
    if labels is None:
        labelled = parsed.where("rule is not null").select(tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), F.col("listed").alias("verdict"))
    else:
        labelled = labels.where("url is not null and verdict is not null").select(tokens(*host_and_path(F.col("url")), F.col("url")).alias("tokens"), "verdict")
    rules, common = mine(labelled)
    open_urls = parsed.where("rule is null and host <> ''").select("url", "host", "path").distinct()
    found = match(open_urls.select("url", tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens")), rules)
    out = parsed.drop("mined", "mined_rule", "mined_confidence", "verdict").join(found, "url", "left")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed", "mined", "mined_rule", "mined_confidence")]
    mined_only = F.col("rule").isNull()
    return out.select(*kept, "host", "path", "rule", F.coalesce("listed", "mined", F.lit(common)).alias("verdict"), F.when(mined_only, F.col("mined_rule")).alias("mined_rule"), F.when(mined_only, F.col("mined_confidence")).alias("mined_confidence"))
