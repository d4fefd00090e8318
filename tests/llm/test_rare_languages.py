"""Language ID on a table where one language is far rarer than the sample."""

import random

from tarnlake import ship
from tarnlake.llm import op10_language_id


def test_rare_language_is_learned(spark):
    ship(spark)
    rng = random.Random(9)
    common, rare = "the of and house river morning letter people".split(), "zug wald und strasse herbst brief leute nicht".split()
    rows = [(i, " ".join(rng.choices(common, k=6)), "en") for i in range(6000)] + [(10000 + i, " ".join(rng.choices(rare, k=6)), "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    new = spark.createDataFrame([(i, " ".join(rng.choices(rare, k=6))) for i in range(20)], "doc_id long, text string")
    out = op10_language_id.predict(spark, new, docs, sample=100).collect()
    assert len(out) == 20 and all(r.lang_pred == "de" for r in out)


def test_shares_fill_the_sample():
    assert op10_language_id.quota([50, 100000], 4000, 200) == 3950
    assert op10_language_id.quota([1000] * 4, 4000, 200) == 1000
    assert op10_language_id.quota([9] * 3, 4000, 200) >= 9
    assert op10_language_id.quota([10000] * 100, 4000, 200) == 200
    assert op10_language_id.quota([], 4000, 200) == 200
