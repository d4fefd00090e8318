"""Every operator on empty tables and on rows of nulls alone, both with further columns whose names clash with helper columns."""

import pytest
from pyspark.sql import functions as F

from tarnlake import ship
from tarnlake.llm import near_copies, op1_packing, op2_sharding, op3_order_minhash, op4_url_rules, op5_simhash, op6_mixing, op7_toxicity, op8_html, op9_embeddings, op10_language_id

CLASHING = "row fp gid side h cell order bytes range top head sketch _w _k key span rest epoch domain _domain _lang _source tokens cap w budget score lang_pred threshold bucket label has anchor mined kept_id component_id child parent v h1 cid weight code raw t fold bad items toxic label_id start length ids _times _last number part node root n text_hash best stays first rank".split()
SCHEMAS = {
    "docs": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "vectors": "vec_id long, embedding array<float>, label int",
}
#: The result for each operator, and how many of three null rows it returns.
CASES = {
    "packing": (lambda s, t: op1_packing.digest(op1_packing.pack(t["docs"])), 3),
    "sharding": (lambda s, t: op2_sharding.shards(s, t["docs"]), 3),
    "order_minhash": (lambda s, t: op3_order_minhash.fingerprints(s, t["docs"]), 3),
    "url_rules": (lambda s, t: op4_url_rules.judge(s, t["pages"], t["labels"]), 3),
    "simhash": (lambda s, t: op5_simhash.classes(s, t["docs"]), 3),
    "keep_one": (lambda s, t: near_copies.keep_one(s, t["docs"]), 1),
    "mixing": (lambda s, t: op6_mixing.mixed(s, t["docs"]), 3),
    "toxicity": (lambda s, t: op7_toxicity.toxicity(s, t["docs"], t["labels"]), 3),
    "clean": (lambda s, t: op7_toxicity.clean(s, t["docs"], t["labels"]), 3),
    "html": (lambda s, t: op8_html.extract(t["pages"]), 3),
    "embeddings": (lambda s, t: op9_embeddings.near(s, t["vectors"]), 3),
    "language_id": (lambda s, t: op10_language_id.predict(s, t["docs"], t["docs"]), 3),
    "accepted": (lambda s, t: op10_language_id.accepted(s, t["docs"]), 0),
}


@pytest.fixture(scope="module")
def tables(spark):
    ship(spark)
    out = {}
    for rows in (0, 3):
        out[rows] = {}
        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame([tuple(None for _ in schema.split(", "))] * rows, schema)
            out[rows][name] = df.select("*", *(F.lit(f"c{i}").alias(c) for i, c in enumerate(CLASHING) if c not in df.columns))
    return out


@pytest.mark.parametrize("rows", [0, 3])
@pytest.mark.parametrize("name", CASES)
def test_no_rows_and_null_rows(spark, tables, name, rows):
    run, of_three = CASES[name]
    out = run(spark, tables[rows])
    assert len(out.collect()) == (of_three if rows else 0)
    if name in ("keep_one", "mixing", "clean", "accepted"):
        assert out.columns == tables[rows]["docs"].columns
