"""URL filters: fixed rules by host and path, and association rules mined from labels.

FP-growth (Spark ML) mines combinations of URL tokens and the label of labelled pages. Rules from tokens to the label
`bad` are pruned by support (a share of pages, and at least `least` pages), by confidence (at least `lift` times the share
of bad pages among all), by significance (the number of bad pages is beyond what that share explains, at `level` shared
over all candidates, by the normal form of the binomial with its correction), and by what a token adds: a rule goes if one
without one of its tokens is as confident. All combinations of a page's tokens count. Before mining only what can't change
a rule goes: tokens that stand in the same pages become one item; tokens in all pages add nothing; tokens of too few bad
pages are in no rule; and a token of bad pages alone is a rule by itself, to which no other token can add. A rule's share
of `level` is that of the combinations mined and the tokens of bad pages alone. The number of combinations, and with it
FP-growth's time, may double with each token that pages share loosely; they are streamed, so memory does not follow it.
A rule matches through an
inverted index on its rarest token: a page meets only rules whose rarest token it has, and fits those whose other tokens
it has too. Fixed rules (host and path prefix, for the host and its subdomains) come first; the longest that fits wins. A
page without a fixed rule is blocked if a mined rule fits, else allowed.

A page is bad if its label is toxic or of low quality. Null urls and urls without :// have an empty host and path and
are allowed unless a mined rule fits them. Pages with a null id have no label; rows that repeat are judged each, and
count once in mining. With no labelled page, or none bad, no rule is mined. Further columns are ignored.
"""

from __future__ import annotations

from math import ceil
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, save, small, table

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
BAD = "label:bad"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels and their words, path segments, names of query parameters."""
    low = F.lower(F.coalesce(url, F.lit("")))
    rest = F.regexp_extract(low, r"(?s)^.*?://(.*)$", 1)
    host, path = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?([^#]*)", 1)
    named = lambda mark, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(named("scheme:", F.array(F.regexp_extract(low, r"(?s)^(.*?)://", 1))), named("host:", F.split(host, r"\.")), F.when(host.contains("-"), named("word:", F.split(host, r"[.\-]"))).otherwise(F.array().cast("array<string>")), named("path:", F.split(path, r"[/.]")), named("query:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1)))))


def fixed_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, _, rest = rule.partition("/")
        out = F.when(((host == at) | host.endswith("." + at)) & path.startswith("/" + rest), F.lit(rule)).otherwise(out)
    return out


def items(spark: SparkSession, baskets: DataFrame, total: int, enough: int) -> tuple[DataFrame, DataFrame]:
    """What is mined: (page, items) of labelled pages, and (item, tokens, freq, hits): the tokens that stand in the same pages."""
    posted = baskets.select("page", "bad", F.explode("tokens").alias("token"))
    cover = posted.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.count_if("bad").alias("hits"), F.sum(F.col("page").cast("decimal(20,0)")).alias("cover"))
    cover = cover.where((F.col("hits") >= enough) & (F.col("freq") < total))
    found = cover.groupBy("freq", "hits", "cover").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    found = save(spark, found.select(F.col("tokens")[0].alias("item"), "tokens", "freq", "hits"), "url-items")  # at most tokens a page / support rows
    merged = posted.join(F.broadcast(found.where("hits < freq").select(F.col("item").alias("token"))), "token")
    merged = merged.groupBy("page").agg(F.collect_list("token").alias("items"), F.max("bad").alias("bad"))
    return merged.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), found


def mined_rules(spark: SparkSession, pages: DataFrame, labels: DataFrame, support: float = 0.002, lift: float = 2.0, least: int = 30, level: float = 0.01) -> DataFrame:
    """(rule, tokens, anchor, size, confidence, support): combinations of tokens that go with bad labels. The anchor is the rarest token."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    urls = pages.where("page_id is not null").select(F.col("page_id").cast("long"), "url").distinct()
    baskets = save(spark, urls.join(known, "page_id").select(F.xxhash64("page_id", "url").alias("page"), tokens(F.col("url")).alias("tokens"), "bad"), "baskets")
    none = spark.createDataFrame([], "rule long, tokens array<string>, anchor string, size int, confidence double, support double")
    total, bad = baskets.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if bad < least or bad == total:
        return none
    enough = max(least, ceil(support * total - 1e-9))
    mined, found = items(spark, baskets, total, enough)
    mined = save(spark, mined, "mined-baskets")
    rules = found.where("hits = freq").select(F.array("item").alias("set"), "hits", "freq")
    if kept := mined.count():
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (enough - 0.5) / kept), minConfidence=1.0).fit(mined)
        sets = save(spark, model.freqItemsets.select(F.array_sort(F.array_remove("items", BAD)).alias("set"), F.array_contains("items", BAD).alias("bad"), "freq"), "url-itemsets")
        rules = rules.unionByName(sets.where("bad and size(set) > 0").select("set", F.col("freq").alias("hits")).join(sets.where("not bad").select("set", "freq"), "set"))
    rules = save(spark, rules.withColumn("confidence", F.col("hits") / F.col("freq")), "url-candidates")
    # all parts of a frequent set are frequent, so each rule finds those with one token less here
    shorter = rules.withColumn("without", F.explode("set")).select("set", F.col("confidence").alias("own"), F.array_remove("set", F.col("without")).alias("part"))
    vain = shorter.join(rules.select(F.col("set").alias("part"), F.col("confidence").alias("of_part")), "part").where("of_part >= own").select("set").distinct()
    base = bad / total
    least_z = NormalDist().inv_cdf(1 - level / max(1, rules.count()))
    z = (F.col("hits") - 0.5 - F.col("freq") * base) / F.sqrt(F.col("freq") * base * (1 - base))
    rules = rules.where((F.col("confidence") >= min(1.0, lift * base)) & (z >= least_z)).join(vain, "set", "left_anti")
    # the items' tokens, and the rarest item's first token as anchor
    named = rules.withColumn("item", F.explode("set")).join(F.broadcast(found.select("item", F.col("tokens").alias("of"), F.col("freq").alias("item_freq"))), "item")
    named = named.groupBy("set", "hits", "confidence").agg(F.array_sort(F.flatten(F.collect_list("of"))).alias("tokens"), F.min(F.struct("item_freq", "item")).alias("a"))
    return named.select(F.xxhash64("tokens").alias("rule"), "tokens", F.col("a.item").alias("anchor"), F.size("tokens").alias("size"), "confidence", (F.col("hits") / total).alias("support"))


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: dict[str, str] | None = None, **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined): mined is the mined rule that fits best, as text."""
    rules = RULES if rules is None else rules
    pages = pages.select("page_id", "url")
    mined = save(spark, mined_rules(spark, pages, labels, **mining), "url-rules")
    # distinct urls meet the index; a page's own tokens decide, so hot tokens cost no more than the rules they anchor
    urls = pages.select("url").distinct()
    posted = urls.select("url", tokens(F.col("url")).alias("has")).withColumn("anchor", F.explode("has"))
    hits = posted.join(small(mined), "anchor").where(F.size(F.array_except("tokens", "has")) == 0)
    best = save(spark, hits.groupBy("url").agg(F.max(F.struct("confidence", "support", F.array_join("tokens", " ").alias("text"))).alias("hit")).select("url", F.col("hit.text").alias("mined")), "url-hits")
    host, path = parts(F.col("url"))
    out = looked_up(spark, pages, best, ["url"], "left").select("page_id", host.alias("host"), path.alias("path"), "mined")
    out = out.withColumn("rule", fixed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    for rule, kind in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(kind)).otherwise(verdict)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
