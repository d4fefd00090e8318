"""Mined rules and verdicts of the whole query against all combinations of tokens, counted one by one."""

import random
from itertools import combinations
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tarnlake.llm import op4_url_rules as op


def made(n, seed, depends=True):
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(n):
        host = f"{rng.choice(['www', 'blog', 'm'])}.{rng.choice(['alpha', 'beta', 'gamma'])}.{rng.choice(['biz', 'info'])}"
        url = f"https://{host}/{rng.choice(['promo', 'news', 'wiki'])}/{rng.choice(['x', 'y'])}"
        bad = rng.random() < (0.9 if depends and "biz" in url and "promo" in url else 0.15)
        pages.append((i, url))
        labels.append((i, int(not bad), 0))
    return pages, labels


def plain_rules(pages, labels, tokens, support=0.002, lift=2.0, least=30, level=0.01):
    bad = {i: not q for i, q, _ in labels}
    total, all_bad = len(pages), sum(bad.values())
    counts = {}
    for i, _ in pages:
        has = [t for t in tokens[i] if sum(t in x for x in tokens.values()) < total]
        for k in range(1, len(has) + 1):
            for c in combinations(sorted(has), k):
                n, h = counts.get(c, (0, 0))
                counts[c] = (n + 1, h + bad[i])
    enough = max(support, least / total) * total
    counts = {c: v for c, v in counts.items() if v[1] >= enough - 1e-9}
    base, z = all_bad / total, NormalDist().inv_cdf(1 - level / max(1, len(counts)))
    conf = {c: h / n for c, (n, h) in counts.items()}
    out = set()
    for c, (n, h) in counts.items():
        if conf[c] >= min(1, lift * base) and (h - 0.5 - n * base) / (n * base * (1 - base)) ** 0.5 >= z:
            if all(conf[p] < conf[c] for p in combinations(c, len(c) - 1) if p):
                out.add(c)
    return out


@pytest.mark.parametrize("depends", [True, False])
def test_rules_and_verdicts_of_the_whole_query(spark, tmp_path, depends):
    pages, labels = made(900, 3, depends)
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/pages.parquet")
    tokens = {r.page_id: r.t for r in df.select("page_id", op.tokens(F.col("url")).alias("t")).collect()}
    want = plain_rules(pages, labels, tokens)
    got = op.mined_rules(spark, df, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert {tuple(r.tokens) for r in got} == want and bool(want) == depends
    assert all(r.anchor in r.tokens for r in got)
    verdict = {r.page_id: r.verdict for r in op.op4_url_rules(spark, str(tmp_path)).collect()}
    assert verdict == {i: "block" if any(set(c) <= set(tokens[i]) for c in want) else "allow" for i, _ in pages}
    assert ("block" in verdict.values()) == depends
    if depends:
        assert {i for i, u in pages if "biz" in u and "promo" in u} <= {i for i, v in verdict.items() if v == "block"}


def test_many_tokens_in_common_are_mined_once(spark):
    rows = [(i, "http://a.b/" + "/".join(f"s{k}" for k in range(25)) + f"/p{i % 7}") for i in range(60)] + [(100 + i, f"http://c.d/q/{i % 5}/" + "/".join(f"t{k}" for k in range(30) if k != i % 40)) for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select(F.col("page_id").alias("doc_id"), (F.col("page_id") >= 100).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = op.judge(spark, pages, labels).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i, _ in rows if i < 100}


def test_no_token_of_a_page_is_cut_from_mining(spark):
    """Bad where two tokens agree that say nothing alone, in pages of twelve tokens that each stand out more."""
    rows = [(i, "http://a.b/" + "/".join([f"x{i % 4}", f"y{i // 4 % 4}"] + [f"f{k}" for k in range(12) if i % (17 + k)])) for i in range(640)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 4 != F.floor(F.col("page_id") / 4) % 4).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = op.mined_rules(spark, pages, labels).collect()
    assert {tuple(r.tokens) for r in got} == {(f"path:x{k}", f"path:y{k}") for k in range(4)}


def test_a_token_of_bad_pages_alone_is_a_rule(spark):
    rows = [(i, f"http://a.b/{'spam' if i % 4 == 0 else 'news'}/{'p' if i % 3 else 'q'}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 4 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    assert [(r.tokens, r.confidence) for r in op.mined_rules(spark, pages, labels).collect()] == [(["path:spam"], 1.0)]
