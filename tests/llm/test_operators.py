"""Each operator on small tables against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake import ship
from tarnlake.llm import near_copies, op1_packing, op2_sharding, op3_order_minhash, op4_url_rules, op5_simhash, op6_mixing, op7_toxicity, op8_html, op9_embeddings, op10_language_id
from tarnlake.llm.components import components

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, gid long"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta,", "gamma!!", "don't", "x1", "été", "Straße", "日本", "<|endoftext|>", "the", "of"]
    texts = [None, "", "  \n\t ", "word", "a b c", " nbsp\x1cfs", " ".join(rng.choices(words, k=30)), " ".join(rng.choices(words, k=9000)), "x" * 5000, "same text here for all", "same text here for all", "123 456 !!!"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src1", "src22", None]), None, 0.5, "r", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], (None, "no id", "en", "src1", 5, 0.1, "r", 1)], SCHEMA)


def test_packing_keeps_every_id_once(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(op1_packing.TOKENIZER))
    got = op1_packing.pack(odd, group_bytes=20_000).toPandas()
    want = sorted((r.doc_id if r.doc_id is not None else -1, [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in odd.collect())
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    single = got[got.doc_id != 6].sort_values(["doc_id", "start"])
    for doc, ids in want:
        if doc != 6:
            part = single[single.doc_id == doc]
            assert np.concatenate([np.frombuffer(x, "<u4") for x in part.ids]).tolist() == ids
            assert (part.start.to_numpy() == np.cumsum([0, *part.length[:-1]])).all() and (part.doc_tokens == len(ids)).all()
    assert got[got.doc_id == 6].length.sum() == 2 * len(dict(want)[6])
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.cumsum([0, *s.length[:-1]]).tolist() and s.length.sum() <= 4096
    digest = op1_packing.digest(op1_packing.pack(odd.where("doc_id = 4"))).first()
    assert digest.ids_crc32 == zlib.crc32(np.array(dict(want)[4], "<u4").tobytes())
    assert op1_packing.pack(odd.limit(0)).count() == 0


def test_first_fit_matches_a_plain_scan():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    free, want = [], []
    for s in sizes:
        b = next((i for i, f in enumerate(free) if f >= s), len(free))
        free += [100] * (b == len(free))
        free[b] -= s
        want.append(b)
    assert op1_packing.first_fit(sizes, 100) == want


def test_sharding_splits_only_what_is_too_large(spark, odd):
    got = op2_sharding.shards(spark, odd, limit=6000).toPandas()
    assert len(got) == odd.count()
    total = got.groupby(["depth", "prefix", "part"]).bytes.agg(["sum", "count"])
    assert ((total["sum"] <= 6000) | (total["count"] == 1)).all()
    assert op2_sharding.shards(spark, odd.limit(0)).count() == 0
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = op2_sharding.shards(spark, docs, limit=20_000).toPandas()
    whole = got.drop_duplicates(["depth", "prefix", "part"])
    for r in whole.itertuples():  # the parent was over the limit
        if r.depth and not r.part:
            h = got.doc_id.map(lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16))
            assert got.bytes[h.map(lambda x: x >> 61 - r.depth) == r.prefix >> 1].sum() > 20_000


def test_order_minhash(spark, odd):
    odd = odd.where("doc_id <> 6 or n_chars is null").dropDuplicates(["doc_id"])  # rows that share an id come in no fixed order
    got = op3_order_minhash.fingerprints(spark, odd, per_range=4).toPandas()
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    texts = [r.text or "" for r in rows]
    want = []
    for i, t in enumerate(texts):
        k, n = len(t) // 3, texts[(i + 1) % len(texts)]
        want.append((len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert sorted(zip(got.n_chars, got.edited_sha256)) == sorted(want)
    by = got.groupby("doc_id").fingerprint.first()
    assert by[9] == by[10] != by[7] and by[0] == by[1] == by[2] == ""
    assert got.near_edited.between(0, 1).all() and got[got.doc_id == 10].near_next.iloc[0] == 1
    assert op3_order_minhash.fingerprints(spark, odd.limit(0)).count() == 0


def test_ranges_are_counted_right(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 10, 300):
        bounds = sorted(rng.sample(range(-500, 500), n))
        got = spark.range(-510, 510, 7).select("id", op3_order_minhash.number_of_range(F.col("id"), bounds).alias("k")).collect()
        assert all(r.k == sum(b <= r.id for b in bounds) for r in got)


def test_order_and_occurrence_change_the_fingerprint(spark):
    a, b = [f"w{i}" for i in range(200)], [f"v{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(a + b)), (2, " ".join(b + a)), (3, " ".join(a + b + a))], "doc_id long, text string")
    s = op3_order_minhash.sketched(df, "text", "s").select("doc_id", "s")
    x = s.alias("x").join(s.alias("y"), F.col("x.doc_id") < F.col("y.doc_id")).select("x.doc_id", F.col("y.doc_id").alias("other"), op3_order_minhash.likeness("x.s", "y.s").alias("like")).collect()
    like = {(r[0], r[1]): r[2] for r in x}
    assert like[1, 2] < 0.8 and like[1, 3] < 1


def test_fixed_url_rules(spark):
    urls = {1: ("https://WWW.Example.com/en/71?x", "www.example.com", "/en/71", "example.com/en/7", "allow"), 2: ("http://a.com/en/", "a.com", "/en/", "com/en/", "block"), 3: ("http://xcom/en/", "xcom", "/en/", None, "allow"), 4: (None, "", "", None, "allow"), 5: ("no scheme.com/en/", "", "", None, "allow"), 6: ("http://b.net/de/1#x", "b.net", "/de/1", "net/de/", "allow"), 7: ("http://example.net/de/8?q", "example.net", "/de/8", "example.net/de/8", "block"), 8: ("http://q.org", "q.org", "", None, "allow")}
    pages = spark.createDataFrame([(k, v[0], "h") for k, v in urls.items()], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op4_url_rules.judge(spark, pages, labels).collect()
    assert {r.page_id: tuple(r)[1:5] for r in got} == {k: v[1:] for k, v in urls.items()}


def test_mined_url_rules_match_by_anchor(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{'bad-spot' if i % 4 == 0 else rng.choice(['a', 'b', 'c'])}.org/x/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in op4_url_rules.judge(spark, pages, labels).collect()}
    assert got == {i: "block" if i % 4 == 0 else "allow" for i, _ in rows}


def test_simhash_classes_match_brute_force(spark, odd):
    import xxhash

    docs = odd.where("doc_id is not null").select("doc_id", "text").unionByName(spark.read.parquet(f"{DIR}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    prints = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for block in (512, 3):  # 3: hot buckets everywhere
        got = op5_simhash.classes(spark, docs, block=block).collect()
        assert len(got) == len(rows) and all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id)) for r in got)
    assert op5_simhash.classes(spark, odd.limit(0)).count() == 0


def test_bit_sliced_groups_find_chance_neighbours():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(0, 200, 2):
        fps[i + 1] = fps[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i % 7, replace=False)))
    gid, side = np.repeat([1, 2, 3], 100), np.tile(np.repeat([0, 1], 50), 3)
    label = op5_simhash.linked(fps, gid, side * (gid == 2), 4)
    near = lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 4 and gid[i] == gid[j] and (gid[i] != 2 or side[i] != side[j])
    pairs = {(i, j) for i in range(300) for j in range(i + 1, 300) if near(i, j)}
    assert all(label[i] == label[j] for i, j in pairs) and {int(x) for x in np.flatnonzero(label != np.arange(300))} == {j for _, j in pairs if True and label[j] != j}
    assert any(b - a == 1 for a, b in pairs)


def test_mixing_fills_budgets(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("_x", F.lit(1))
    got = op6_mixing.mix(spark, docs, budget=0.5)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.sql(op6_mixing.SQL).fetchall()
    again = op6_mixing.op6_mixing(spark, DIR).collect()
    assert sorted(map(tuple, again)) == sorted(want)
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, taken = sum(tokens(r.text) for r in docs.collect()), sum(r.taken for r in got.collect())
    leaves = docs.select("lang", "source").distinct().count()
    assert 0.5 * total - leaves <= taken <= 0.5 * total  # nothing of a share is left over but parts of a token
    assert all(r.tokens == tokens(r["row"].text) and (0 < r.taken <= r.tokens or r.tokens == 0) for r in got.collect())
    clash = odd.withColumn("_domain", F.lit(1)).withColumn("epoch", F.lit(2)).withColumn("kept_id", F.lit(3))
    assert op6_mixing.mixed(spark, clash).columns == clash.columns
    assert near_copies.keep_one(spark, clash).columns == clash.columns
    assert op6_mixing.mix(spark, odd.limit(0)).count() == 0


def test_toxicity_learns_and_handles_odd_texts(spark, odd):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        w = [f"w{rng.randint(0, 300)}" .replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j") for _ in range(40)]
        if i % 3 == 0:
            w[rng.randint(0, 39)] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(w), "en", int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = docs.select("doc_id", "toxic", F.lit(1).alias("quality")).where("doc_id < 450")
    out = op7_toxicity.toxicity(spark, docs, labels).select("row.doc_id", "score").collect()
    wrong = sum((r.score >= 0.7) != (r.doc_id % 3 == 0) for r in out if r.doc_id >= 450)
    assert wrong <= 3
    scores = op7_toxicity.toxicity(spark, docs, labels, rows=odd).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert op7_toxicity.clean(spark, odd, labels.limit(0)).columns == odd.columns
    assert all(r.score == 0 for r in op7_toxicity.toxicity(spark, odd, labels.limit(0)).collect())


PAGE = "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class='cookie notice'>We use cookies</div><div id=main>{}</div><aside>Side</aside><div class=comments><article class=comment><p>Nice post with rather many words in it, really</p></article></div><form><label>Name</label></form><footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        (PAGE.format("<article><h1>Title</h1><p>One <b>bold</b>\n text &lt;x&gt;<p>Two<ul><li>a<li>b</ul><script>if (a<b) {}</script><div class=ad>Buy</div></article>"), "Title\nOne bold text <x>\nTwo\na\nb"),
        (PAGE.format("<h2>Head</h2><p>Body text of some length, with words enough to count.</p><p>More.</p>"), "Head\nBody text of some length, with words enough to count.\nMore."),
        ("<p>a < b and c</p><!-- no --><p title='x > y'>d</p>", "a < b and c\nd"),
        ("<body><nav><p>only menu</p></nav>", ""),
    ],
)
def test_main_text(page, want):
    assert op8_html.main_text(page) == want


def test_extraction_keeps_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>", "u", "t"), (1, "<p>x</p>", "u", "t"), (2, None, None, None)], "page_id long, html string, main_text string, row string")
    assert sorted((r["row"].page_id, r.main_text) for r in op8_html.extract(pages).collect()) == [(1, "x"), (1, "x"), (2, "")]


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base[i % 30][None] + rng.normal(scale=0.02, size=(1, 16)) for i in range(200)]).astype(np.float32).astype(float)
    rows = [(i, x.tolist(), i % 30 % 2) for i, x in enumerate(v)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, v[0].tolist(), None), (504, v[0].tolist(), 0), (504, v[0].tolist(), 0), (505, [None] * 16, 1), (506, [], 1), (507, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [(i, np.array(x), lab) for i, x, lab in rows if x and len(x) == 16 and lab is not None and None not in x and np.isfinite(x).all() and any(x)]
    want = {}
    for a, (i, x, lab) in enumerate(ok):
        want[i] = sum(1 for b, (_, y, m) in enumerate(ok) if a != b and m == lab and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93)
    for block in (256, 5):
        got = op9_embeddings.near(spark, df, block=block).collect()
        assert len(got) == len(rows) and all(r.n_links == want.get(r.vec_id, 0) for r in got)
    assert {r.vec_id: r.component_id for r in got}[504] == 0
    wide = op9_embeddings.near(spark, df, tables=(2, 26)).collect()  # the shape of larger inputs
    assert all(r.n_links <= want.get(r.vec_id, 0) for r in wide) and sum(r.n_links for r in wide) >= 0.95 * sum(r.n_links for r in got)
    assert op9_embeddings.near(spark, df.limit(0)).count() == 0


def test_tables_follow_the_size_of_a_label():
    shapes = [op9_embeddings.shape(n, 0.93, 0.97, 256) for n in (0, 1 << 16, 1 << 17, 1 << 24, 1 << 25)]
    assert shapes == [(1, 8), (1, 8), (2, 26), (2, 26), (3, 74)]
    agree = lambda width: (1 - np.arccos(0.93) / np.pi) ** (8 * width)
    assert all(1 - (1 - agree(w)) ** k >= 0.97 for w, k in shapes)


def test_language_model_sums_all_segmentations():
    keys = np.unique(op10_language_id.hashes(np.array([[ord(c)] for c in "ab▁"], np.uint32)).tolist() + op10_language_id.hashes(np.array([[ord("a"), ord("b")]], np.uint32)).tolist()).astype(np.uint64)
    at = {s: int(np.searchsorted(keys, op10_language_id.hashes(np.array([[ord(c) for c in s]], np.uint32))[0])) for s in ("a", "b", "▁", "ab")}
    p = np.zeros((len(keys) + 2, 1))
    p[at["a"]], p[at["b"]], p[at["▁"]], p[at["ab"]], p[-2] = 0.2, 0.3, 0.1, 0.4, 1e-7
    got = np.exp(op10_language_id.Lattice(["▁ab", "▁aab", "▁q"], keys).forward(p))[:, 0]
    assert np.allclose(got, [0.1 * (0.2 * 0.3 + 0.4), 0.1 * 0.2 * (0.2 * 0.3 + 0.4), 0.1 * 1e-7])
    counts = op10_language_id.Lattice(["▁ab"], keys).expected(p, np.array([0]), np.array([2]))
    assert np.isclose(counts[at["ab"], 0], 2 * 0.4 / 0.46) and np.isclose(counts[at["a"], 0], 2 * 0.06 / 0.46)


def test_language_id_on_held_out_documents(spark, odd):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = op10_language_id.op10_language_id(spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    out = op10_language_id.predict(spark, odd, docs).collect()
    assert len(out) == odd.count() and {r["row"].doc_id for r in out if r.lang_pred == "und"} == {0, 1, 2, 11}
    assert op10_language_id.accepted(spark, odd).columns == odd.columns
    assert all(r.lang_pred == "und" for r in op10_language_id.predict(spark, odd, docs.limit(0)).collect())


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (102, 101), (102, 100)], "child long, parent long")
    got = {r.child: r.parent for r in components(spark, links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, DIR)
        assert out.columns == docs.columns
        ids, before = [r.doc_id for r in out.select("doc_id").collect()], {r.doc_id for r in held.select("doc_id").collect()}
        assert len(ids) == len(set(ids)) and set(ids) <= before and ids
        held = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, held, DIR).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in held.collect()}
