"""Mixing sources to target weights: hierarchical budgeting, by DataFrame functions only.

A token budget is handed down a tree of domain, language and source. At each node it is shared among the children by
weight, but no child gets more than the leaves below it can supply (their tokens times max_epochs); what a child can't
take goes to its siblings by weight, and only when all of them are full to the node's own siblings (water filling, in
closed form by window sums). A leaf reads whole epochs while its share lasts, then a token-prefix of one more: documents
in the order of a hash of seed, epoch and id, and of the document at the cut its first tokens, so that nothing of a share
is left over. The cut of that prefix is found from sums over 4096 ranges of the hash and the rows of one range, so a hot
source is never sorted whole.

Tokens are words between ASCII white space. Null languages and sources are a leaf `none`; a null text has no token and
is taken with whole epochs, or where its hash is below the cut. Rows that share the id at the cut are each read in part,
in proportion to their tokens (rounded down). Weights that are not given are 1. Further columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, small, table

DOMAINS = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}
LANGUAGES = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
LEAF = ["_domain", "_lang", "_source"]
WIDTH, RANGE_BITS = 60, 12


def by_number(source: Column) -> Column:
    """Default domain: the number at the end of the source's name modulo 4."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1)
    return F.concat(F.lit("d"), F.pmod(F.when(n == "", F.lit("0")).otherwise(n).cast("int"), F.lit(4)).cast("string"))


def weight(c: str, given: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in given.items():
        out = F.when(F.col(c) == k, F.lit(float(v))).otherwise(out)
    return out


def poured(nodes: DataFrame, name: str, above: list[str]) -> DataFrame:
    """nodes (with cap, w and budget) with `share`: the budget of all above them by weight, none beyond its cap."""
    group = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("cap") / F.col("w"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.withColumn("full", F.col("cap") / F.col("w") <= (F.col("budget") - before) / after)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(group)
    open_ = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(group)
    return nodes.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * (F.col("budget") - taken) / open_))


def key(seed: int, epoch: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def leaves(spark: SparkSession, docs: DataFrame, domain: Column, budget: float, domains: dict, languages: dict, sources: dict, max_epochs: int, seed: int) -> DataFrame:
    """For each leaf: how many whole epochs, and the largest hash of the one after them (-1: none of it)."""
    named = docs.select("doc_id", domain.alias("_domain"), F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("_lang"), F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("_source"), tokens().alias("tokens"))
    rows = save(spark, named, "mix-rows")
    leaf = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * F.lit(float(max_epochs)))
    top = leaf.groupBy("_domain").agg(F.sum("cap").alias("cap")).withColumn("w", weight("_domain", domains))
    total = F.sum("cap").over(Window.partitionBy(F.lit(0))) / max_epochs * budget
    top = poured(top.withColumn("budget", total), "_domain", []).select("_domain", F.col("share").alias("budget"))
    middle = leaf.groupBy("_domain", "_lang").agg(F.sum("cap").alias("cap")).withColumn("w", weight("_lang", languages)).join(top, "_domain")
    middle = poured(middle, "_lang", ["_domain"]).select("_domain", "_lang", F.col("share").alias("budget"))
    low = poured(leaf.withColumn("w", weight("_source", sources)).join(middle, ["_domain", "_lang"]), "_source", ["_domain", "_lang"])
    share = F.floor(F.col("share") + 1e-6)
    epochs = F.when(F.col("tokens") > 0, F.floor(share / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    low = save(spark, low.select(*LEAF, "tokens", share.alias("share"), epochs.alias("epochs"), (share - epochs * F.col("tokens")).cast("long").alias("rest")), "mix-leaves")
    keyed = rows.join(small(low.drop("tokens", "share")), LEAF).select(*LEAF, "tokens", "rest", key(seed, F.col("epochs") + 1).alias("key"))
    keyed = keyed.withColumn("span", F.shiftright("key", WIDTH - RANGE_BITS))
    spans = keyed.groupBy(*LEAF, "span", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("span"))
    cut = spans.withColumn("upto", upto).where("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("span", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))).alias("c")).select(*LEAF, F.col("c.span").alias("span"), "c.room")
    cut = save(spark, cut, "mix-cuts")
    inside = keyed.drop("rest").join(small(cut), [*LEAF, "span"]).groupBy(*LEAF, "key", "room").agg(F.sum("tokens").alias("tokens"))
    over = (F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("key")) - F.col("room")).alias("over")
    ends = inside.select(*LEAF, "key", "tokens", over).where("over > 0").groupBy(*LEAF).agg(F.min(F.struct("key", "tokens", "over")).alias("c"))
    ends = ends.select(*LEAF, F.col("c.key").alias("last"), F.col("c.tokens").alias("last_tokens"), (F.col("c.tokens") - F.col("c.over")).alias("room"))
    # without a cut the rest covers the whole epoch: that is a leaf without tokens
    return save(spark, low.join(ends, LEAF, "left").select(*LEAF, "share", "epochs", F.coalesce("last", F.lit(1 << WIDTH)).alias("last"), F.coalesce("last_tokens", F.lit(1)).alias("last_tokens"), F.coalesce("room", F.lit(0)).alias("room")), "mix-cut-leaves")


def tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(spark: SparkSession, docs: DataFrame, domain: Column | None = None, budget: float = 0.6, domains: dict | None = None, languages: dict | None = None, sources: dict | None = None, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """(row, domain, epoch, tokens, taken): `row` holds the columns of docs, so no name can clash; a row for each epoch in
    which a document is read, with its tokens and how many of them are, from the first on. budget: tokens to take, as a share of all."""
    domain = by_number(F.col("source")) if domain is None else domain
    leaf = leaves(spark, docs, domain, budget, domains or DOMAINS, languages or LANGUAGES, sources or {}, max_epochs, seed)
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", tokens().alias("_tokens"), domain.alias("_domain"), F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("_lang"), F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("_source"))
    read = named.join(small(leaf.select(*LEAF, F.col("epochs").alias("_epochs"), F.col("last").alias("_last"), "last_tokens", "room")), LEAF).withColumn("_key", key(seed, F.col("_epochs") + 1))
    part = F.when(F.col("_key") == F.col("_last"), F.expr("_tokens * room div last_tokens")).otherwise(F.lit(0))
    read = read.withColumn("_part", part).withColumn("_times", F.col("_epochs") + ((F.col("_key") < F.col("_last")) | (F.col("_part") > 0)).cast("long"))
    read = read.where("_times > 0").select("row", F.col("_domain").alias("domain"), F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("epoch"), F.col("_tokens").alias("tokens"), "_part", "_epochs")
    return read.select("row", "domain", "epoch", "tokens", F.when((F.col("epoch") > F.col("_epochs")) & (F.col("_part") > 0), F.col("_part")).otherwise(F.col("tokens")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of one epoch at most, whole and with the columns of docs; that at a leaf's cut stays if at least half of it is taken."""
    return mix(spark, docs, max_epochs=1).where("2 * taken >= tokens").select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(spark, docs).select("row.doc_id", "domain", "row.lang", "row.source", "epoch", "taken")


def _case(c: str, given: dict[str, float]) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in given.items()) + " else 1.0 end"


def _pour(source: str, name: str, above: str) -> str:
    """SQL of poured()."""
    part = f"partition by {above}" if above else ""
    return f"""(select *, case when fits then cap else w * (budget - sum(case when fits then cap else 0.0 end) over ({part})) / nullif(sum(case when fits then 0.0 else w end) over ({part}), 0) end as share from (
      select *, cap / w <= (budget - coalesce(sum(cap) over ({part} order by cap / w, {name} rows between unbounded preceding and 1 preceding), 0)) / sum(w) over ({part} order by cap / w, {name} rows between current row and unbounded following) as fits from {source}))"""


#: Prefixes by one running sum over each leaf.
SQL = f"""
with d as (select doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as int), 0) % 4) as domain, lang, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens from documents),
leaf as (select domain, lang, source, sum(tokens)::bigint as tokens, sum(tokens)::double * 2.0 as cap from d group by all),
a0 as (select domain, cap, {_case("domain", DOMAINS)}::double as w, sum(cap) over () / 2 * 0.6 as budget from (select domain, sum(cap) as cap from leaf group by all)),
a as (select domain, share as budget from {_pour("a0", "domain", "")}),
b0 as (select x.domain, x.lang, x.cap, {_case("x.lang", LANGUAGES)}::double as w, a.budget from (select domain, lang, sum(cap) as cap from leaf group by all) x join a using (domain)),
b as (select domain, lang, share as budget from {_pour("b0", "lang", "domain")}),
c0 as (select leaf.*, 1.0::double as w, b.budget from leaf join b using (domain, lang)),
c as (select domain, lang, source, tokens, floor(share + 1e-6)::bigint as share from {_pour("c0", "source", "domain, lang")}),
e as (select *, case when tokens > 0 then share // tokens else 0 end as epochs from c),
k as (select d.doc_id, d.domain, d.lang, d.source, d.tokens, e.epochs, e.share - e.epochs * e.tokens as rest, ('0x' || substr(md5('17|' || (e.epochs + 1) || '|' || d.doc_id), 1, 15))::bigint as key from d join e using (domain, lang, source)),
s as (select *, sum(tokens) over (partition by domain, lang, source order by key) as upto from k),
t as (select *, epochs + case when upto <= rest or rest > upto - tokens then 1 else 0 end as times from s),
u as (select *, unnest(range(1, times + 1)) as epoch from t)
select doc_id, domain, lang, source, epoch, case when epoch > epochs and upto > rest then rest - upto + tokens else tokens end::bigint as taken from u
"""
