"""The training-data operators against brute force, SQL, round trips and awkward rows."""

import itertools
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quirework.llm import decontaminate, langid, licenses, mixing, quality, queries, rules, simhash, toxicity, url_rules, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, root string"
#: Null and repeated ids, null, empty and long texts, and a column whose name the operators use inside.
ODD = [(1, None, "en", "a", "x"), (2, "", None, None, "x"), (2, "", None, None, "x"), (None, "one two three", "en", "a", None), (3, "word " * 30_000, "en", "b", "x"), (4, "The cat sat on the mat and looked at the moon.", None, "b", "x"), (4, "Ganz andere Worte stehen hier.", "de", None, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    key = lambda cols, rs: sorted(tuple(str(round(float(r[i]), 6)) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in rs)
    assert key(got.columns, [tuple(r) for r in got.collect()]) == key(names, want.fetchall())


def subsequences(s):
    out = defaultdict(float)
    for c in itertools.combinations(range(len(s)), 3):
        out["".join(s[i] for i in c)] += 0.9 ** (c[-1] - c[0] + 1)
    return out


def kernel(s, t):
    a, b = subsequences(s), subsequences(t)
    return sum(a[k] * b[k] for k in a)


def test_kernel_against_all_subsequences():
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdé") for _ in range(draw.randrange(3, 9))) for _ in range(12)]
    got = toxicity.features(words, words[:5], 0.9)
    for i, s in enumerate(words):
        for j, t in enumerate(words[:5]):
            assert got[i, j] == pytest.approx(kernel(s, t) / (kernel(s, s) * kernel(t, t)) ** 0.5, rel=1e-4, abs=1e-6)


def test_toxicity_scores_against_brute_force():
    """The folded weights give what the SVM gives on plain kernel values with its landmarks."""
    marks, weights = ["^idiot$", "^the$", "clum"], np.array([1.5, -0.7, 0.4])
    model = toxicity.Model(marks, weights, -0.3, 0.9)
    units = ["^idiot$", "^idxiot$", "^a$", "^clumsy$", "^zzz$", "^thé$"]
    want = [sum(w * kernel(u, m) / max(kernel(u, u) * kernel(m, m), 1e-12) ** 0.5 for w, m in zip(weights, marks, strict=True)) - 0.3 for u in units]
    assert model.margins(units) == pytest.approx(np.maximum(want, -1), abs=1e-4)


@pytest.mark.parametrize("change", [lambda w: w, " ".join, lambda w: f"{w[:2]}*{w[2:]}", lambda w: f"{w[:2]}x{w[2:]}", lambda w: f"zu{w}er"])
def test_toxicity_recalls_each_of_many_insults(change):
    draw = random.Random(5)
    word = lambda letters, lo, hi: "".join(draw.choice(letters) for _ in range(draw.randrange(lo, hi)))
    clean, insults = [word("nrtaeosl", 3, 8) for _ in range(2000)], [word("bcdfgiklmopquvwxyz", 4, 10) for _ in range(48)]
    text = lambda extra: " ".join([*draw.sample(clean, 20), *extra, *draw.sample(clean, 15)])
    vary = lambda w, k: (w, " ".join(w), f"{w[:2]}-{w[2:]}", f"{w[:3]}x{w[3:]}")[k % 4]
    model = toxicity.train([(text([vary(insults[i % 48], i // 48)]), 1) for i in range(960)] + [(text([]), 0) for _ in range(1200)])
    scores = toxicity._Scores(model)
    told = model.probability(scores.documents([text([change(w)]) for w in insults]))
    assert (told >= 0.5).mean() >= 0.9
    assert (model.probability(scores.documents([text([]) for _ in range(300)])) < 0.5).mean() > 0.98


def test_toxicity_finds_gapped_insults():
    draw = random.Random(3)
    clean = ["".join(draw.choice("nrtaeosl") for _ in range(draw.randrange(3, 8))) for _ in range(400)]
    text = lambda extra: " ".join([*draw.sample(clean, 20), *extra, *draw.sample(clean, 5)]) + "."
    model = toxicity.train([(text([draw.choice(["idiot", "clumpy"])]), 1) for _ in range(80)] + [(text([]), 0) for _ in range(200)])
    told = model.probability(toxicity._Scores(model).documents([text(["idiot"]), text(["i", "d", "i", "o", "t"]), text(["id*iot"]), text([]), "", None]))
    assert (told[:3] > 0.5).all() and (told[3:] < 0.5).all()


def test_the_mask_misses_no_window_with_two_substitutions():
    for bad in itertools.combinations(range(13), 2):
        assert any(not {p + k for k in mask} & set(bad) for mask in decontaminate.MASKS for p in range(13 - mask[-1]))


def test_decontamination_tolerates_substitution(spark):
    for n in range(decontaminate.ONE_OFF, decontaminate.WINDOW):
        assert all(any(bad - p not in mask for mask in decontaminate.MASKS for p in range(n - mask[-1])) for bad in range(n))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    near = item.replace("delta", "x").replace("kappa", "y")
    docs = spark.createDataFrame([(1, f"so {near} end"), (2, "nothing of the kind is said here at all, and so it goes on and on"), (None, f"Oh, {item.upper()}!")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (8, "too short"), (9, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()} == {(1, 7), (None, 7)}
    assert [r.doc_id for r in decontaminate.remove(docs, items).collect()] == [2]


def test_short_items(spark):
    ten = "one two three four five six seven eight nine ten"
    texts = {1: f"and {ten.replace('six', 'x')} more", 2: f"{ten.replace('six', 'x').replace('two', 'y')}", 3: "who wrote the famous book", 4: "so who wrote the famous book then", 5: "Yes, indeed!", 6: "yes indeed they did", 7: "who wrote the other book"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, ten), (2, "Who wrote the famous book?"), (3, "yes indeed")], "item_id long, text string")
    want = {(1, 1), (3, 2), (4, 2), (5, 3)}
    for most in (1_000_000, 0):  # broadcast, and shuffled
        assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items, most=most).collect()} == want


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", "en", 5, "a", 7, 8), (2, "alpha beta gamma delta epsilon zeta", "en", 5, "a", 7, 8), (None, "something else is said here", "en", 5, "b", 7, 8)], "doc_id long, text string, lang string, _id long, _hash string, _said long, _stats long")
    docs = docs.withColumns({c: F.lit("own") for c in ("_mark", "_odd", "_node", "_root", "_fp7", "at", "seed", "node", "token", "root", "h", "n")})
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.doc_id for r in decontaminate.remove(docs, items).collect()] == [None]
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(docs).collect()) == [0, 1]
    for kept in (decontaminate.remove(docs, items), simhash.keep_one(docs), langid.keep_identified(docs), rules.keep_good(docs, labels)):
        assert kept.columns == docs.columns and all(r._mark == r.node == "own" for r in kept.collect())


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowd", [2, 32])
def test_simhash_components_against_all_pairs(spark, crowd):
    draw = random.Random(4)
    base = [draw.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << i for i in draw.sample(range(64), draw.randrange(4))) for b in base for _ in range(20)} | set(base)
    signed = [simhash._signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {x: x for x in signed}
    find = lambda x: x if root[x] == x else find(root[x])
    for x, y in itertools.combinations(signed, 2):
        if bin((x ^ y) & (2**64 - 1)).count("1") <= 2:
            a, b = sorted((find(x), find(y)))
            root[b] = a
    got = {x: x for x in signed} | {r.node: r.root for r in simhash.components(simhash.links(df, crowd)).collect()}
    assert got == {x: find(x) for x in signed}


def test_simhash_fingerprints_and_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    texts = {t for _, t, *_ in ODD}
    assert {r.fp & (2**64 - 1) for r in got} == {brute_fingerprint(t) for t in texts}
    assert {(r.doc_id, r.component_id) for r in got if r.fp == 0} == {(1, 1), (2, 1)}
    kept = simhash.keep_one(odd).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == sorted((i or 0, t) for i, t, *_ in set(ODD) if t)
    assert sum(not r.text for r in kept) == 1


def test_keep_one_keeps_one_of_all_similar_texts(spark):
    draw = random.Random(6)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    texts = []
    for _ in range(15):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(5, 150))]
        for k in (0, 1, 1, 2, 3):
            words = list(base)
            for _ in range(k):
                words[draw.randrange(len(words))] = f"x{draw.randrange(5000)}"
            texts.append(" ".join(["a line that many of the texts begin with", *words]))
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    wide = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            wide += bin(brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[j])).count("1") > 2
            a, b = sorted((find(i), find(j)))
            root[b] = a
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert wide > 20 and {r.doc_id for r in kept.collect()} == {find(i) for i in range(len(texts))}


def test_rule_statistics():
    n, chars, symbols, dup, repeat, *_ = rules.statistics("a b c d e\na b c d e\n \n#x #x\n#x #x")
    assert (n, chars, symbols, dup) == (14, 18, 4, 2)

    def brute(w):
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)})

    draw = random.Random(5)
    for _ in range(200):
        t = " ".join(draw.choice("ab") for _ in range(draw.randrange(40)))
        assert rules.statistics(t)[4] == brute(t.split())
    assert repeat == 10


def test_quality_rules_on_all_documents(spark):
    judged = queries.op8_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(judged, on="doc_id")
    bad, good = labels[labels.quality == 0], labels[(labels.quality == 1) & ~labels.base_failed]
    assert (~bad.kept).mean() > 0.9 and good.kept.mean() > 0.97


@pytest.mark.parametrize(("name", "truth", "least"), [("op1_toxicity", "toxic", 0.95), ("op7_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, truth, least):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    told = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    assert len(got) == 1000 and (told.predicted == told[truth]).mean() >= least


def test_language_id_held_out(spark):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & (got.lang_pred != "und")]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_language_scores_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    model = langid.fit(docs)
    texts = [r.text for r in docs.limit(40).collect()] + ["", "...", "Ä", "a  b", "x" * 3]
    pre = np.log(np.array([docs.where(F.col("lang") == x).count() for x in model.langs]) / docs.where("lang is not null").count())
    lang, score, _ = model.scores([*texts, None])
    for t, got, p in zip(texts, lang, score, strict=False):
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in t)
        s = np.array([ord(c) for c in " " + " ".join(letters.split()) + " "] if letters.strip() else [], np.uint32)
        if not len(s):
            assert (got, p) == ("und", 0)
            continue
        total = pre + sum(model.log_prob[i][b] for i, order in enumerate(langid.ORDERS) for b in langid.buckets(s, order, model.bits))
        assert got == model.langs[int(total.argmax())] and p == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-3)
    assert (lang[-1], score[-1]) == ("und", 0)


def test_language_stage_rejects_what_is_in_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "щука лежит на берегу и смотрит на луну " * 5, None), (-2, "xqzjkw vvkqx zzqjx wqkxj qqzvx jxkqw " * 5, "en"), (-3, "1234 5678", "en"), (-4, None, "en")], "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs.unionByName(odd))
    assert kept.where("doc_id < 0").count() == 0 and kept.count() >= 0.99 * docs.count()


def test_an_empty_language_name_is_learned(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "")], "doc_id long, text string, lang string")
    assert langid.fit(docs).scores(["other words"])[0] == [""]


def test_quality_scores_against_brute_force(spark):
    """The query's scores are those of densities by their definition, with plain inverses and determinants, over all learned rows."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    told = docs.join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "text", "quality", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held")).toPandas()
    x = np.stack([np.array(quality.statistics(t), float) for t in told["text"]])
    learned = {v: x[((told["quality"] == v) & ~told["held"]).to_numpy()] for v in (0, 1)}
    total = sum(map(len, learned.values()))
    own = {v: np.cov(rows.T, bias=True) for v, rows in learned.items()}
    pooled = sum(len(learned[v]) * own[v] for v in own) / total
    log_density = []
    for v in (0, 1):
        cov = 0.9 * own[v] + 0.1 * pooled
        cov = 0.99 * cov + 0.01 * np.trace(cov) / len(cov) * np.eye(len(cov))
        away = x - learned[v].mean(axis=0)
        log_density.append(np.log(len(learned[v]) / total) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)))
    want = 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0], -500, 500)))
    got = queries.op7_quality(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id").loc[told["doc_id"], "score"].to_numpy()
    assert np.abs(got - want).max() < 1e-6


def plain_forest(x, trees, sample, draw):
    """A recursive forest over the same rows, each tree a nested tuple."""
    def grow(rows, depth, most):
        wide = [f for f in range(x.shape[1]) if rows[:, f].max() > rows[:, f].min()] if len(rows) > 1 else []
        if depth >= most or not wide:
            return depth + rules.average_path(len(rows))
        f = draw.choice(wide)
        at = draw.uniform(rows[:, f].min(), rows[:, f].max())
        return f, at, grow(rows[rows[:, f] <= at], depth + 1, most), grow(rows[rows[:, f] > at], depth + 1, most)

    def path(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    n = min(sample, len(x))
    grown = [grow(x[draw.choice(len(x), n, replace=False)], 0, int(np.ceil(np.log2(max(2, n))))) for _ in range(trees)]
    return np.array([2.0 ** -(np.mean([path(t, row) for t in grown]) / rules.average_path(n)) for row in x])


def test_forest_against_a_plain_one():
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(0, 1, (400, 3)), draw.normal(6, 1, (5, 3))])
    got, want = rules.IsolationForest(x, trees=200).score(x), plain_forest(x, 200, 256, draw)
    assert np.abs(got - want).max() < 0.06 and np.corrcoef(got, want)[0, 1] > 0.98


def test_mined_rules_against_brute_force(spark):
    draw = random.Random(9)
    urls = [({f"t{k}" for k in range(6) if draw.random() < 0.5} | ({"a", "b"} if i % 3 else set()), "block" if i % 3 == 1 and draw.random() < 0.97 else "allow") for i in range(120)]
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in url_rules.mine(spark.createDataFrame([(sorted(t), v) for t, v in urls], "tokens array<string>, verdict string"), 0.05, 0.9).collect()}
    every = sorted(set().union(*[t for t, _ in urls]) - {"b"})  # a and b occur in the same urls; b only counts alone
    found = {}
    for k in range(1, len(every) + 1):
        for c in itertools.combinations(every, k):
            with_ = [v for t, v in urls if set(c) <= t]
            for v in ("allow", "block"):
                if with_ and with_.count(v) >= 6 and with_.count(v) >= 0.9 * len(with_):
                    found[c, v] = (with_.count(v) / len(with_), with_.count(v) / 120)
    want = {(c, v): s for (c, v), s in found.items() if not any((d, v) in found and found[d, v][0] >= s[0] for d in [tuple(x for x in c if x != o) for o in c] if d)}
    assert {k: (round(a, 9), round(b, 9)) for k, (a, b) in got.items()} == {k: (round(a, 9), round(b, 9)) for k, (a, b) in want.items()} and want


def test_shared_paths_do_not_multiply(spark):
    rows = [(i, f"http://a{i % 2}.com/" + "/".join("abcdefghijklmnopqrst") + f"/{'de' if i % 2 else 'fr'}") for i in range(40)]
    rules_ = (("block", "a0.com", "/"), ("allow", "a1.com", "/"))
    assert url_rules.judge(spark.createDataFrame([*rows, (99, "http://b.com/a/b/c"), (98, "http://b.com/a b/c")], "page_id long, url string"), rules=rules_, support=0.1).count() == 42


def test_mix_of_rows_alike(spark):
    """Null ids and rows alike are split as the target asks, and reruns agree."""
    rows = [(None, "one two three four", "a")] * 500 + [(i, "w " * (1 + i % 9), "a") for i in range(400)] + [(None, "x y", "b")] * 300 + [(1, "z", None), (1, None, None), (2, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs).cache()
    assert got.count() == len(rows)
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect():
        assert abs(r.taken - r.target) <= r.most and r.over <= 0
    key = lambda df: sorted(map(str, df.select("doc_id", "source", "size", "copies").collect()))
    assert key(got) == key(mixing.mix(docs.repartition(3)))


def test_mix_rates_solve_the_dual(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("target < 2 * source_size").cache()
    for r in got.groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("words"), F.first("target").alias("target")).collect():
        assert r.words == pytest.approx(r.target, rel=1e-6)
    for r in got.where("rate < 2 and size > 0").groupBy("source").agg(F.stddev(F.log("rate") / F.col("size")).alias("off"), F.avg(F.abs(F.log("rate") / F.col("size"))).alias("tilt")).collect():
        assert (r.off or 0) < 1e-3 * r.tilt + 1e-9


def test_mix_takes_few_jobs(spark):
    """Newton steps are no jobs of their own: with the driver's plans of each the driver's memory grew."""
    spark.sparkContext.setJobGroup("mix", "mix")
    try:
        assert mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).agg(F.sum("taken")).first()[0] > 0
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("mix")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert 0 < len(jobs) <= 100


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "nothing")], "item_id long, text string")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        assert rules.judge(docs, labels).count() == n and mixing.mix(docs).count() == n
        assert docs.select(langid.predict_column(docs, langid.fit(docs), F.col("text"))).count() == n
        assert docs.select(toxicity.score_column(docs, toxicity.fit(docs, labels), F.col("text"))).count() == n
        assert rules.keep_good(docs, labels).columns == docs.columns == langid.keep_identified(docs).columns
        assert decontaminate.remove(docs, items).count() == n and licenses.scan(docs).count() == 0
        assert simhash.near_duplicates(docs).count() == n


def test_mix_meets_its_targets(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    near = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in near) and got.where("taken > 2 * size").count() == 0


def test_url_parts_rules_and_verdicts(spark):
    urls = ["https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://other.org", "x://shop.com/fr/", "http://shop.com/de/a", "nothing", None, "http://shop.net/de/a"]
    got = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), support=0.1).collect()}
    assert [got[i].rule for i in range(8)] == ["example.org/es/", "example.org/en/1", None, "com/fr/", "com/de/", None, None, None]
    assert (got[0].host, got[0].path, got[5].host, got[6].path) == ("a.example.org", "/es/1", "", "") and got[4].verdict == "block"


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (4, "http://c/", ""), (4, "http://c/", "")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = [(r.id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, str(tmp_path / "w")).collect()]
    assert sorted(got) == [(1, "response", None, 9), (2, "response", None, 0), (3, "revisit", "1", 9), (4, "revisit", "2", 0), (4, "revisit", "2", 0)]
    for r in warc.records(spark, str(tmp_path / "w")).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body[:n].decode() == ("<p>é</p>" if r.id in (1, 3) else "") and body[n:] == b"\r\n\r\n"
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == 2


def test_pipeline_against_plain_restatements(spark, con):
    """Every stage of run() on what the stage before it left: rules and language by the models' scores, near-dedup by all pairs, the rest by SQL."""
    import corpus_pipeline

    seen, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen.append(docs.toPandas())
    assert sorted(seen[-1].itertuples(index=False)) == sorted(corpus_pipeline.run(spark, SF).toPandas().itertuples(index=False))
    assert all(list(x.columns) == first.columns for x in seen[:4])
    start = first.toPandas()
    judged = rules.judge(first, spark.read.parquet(f"{SF}/labels.parquet")).toPandas().set_index("doc_id")
    plain = {i for i, t in zip(start.doc_id, start.text, strict=True) if len((t or "").split()) >= 10}
    assert set(seen[0].doc_id) == set(judged.index[judged.kept]) <= plain
    known = spark.createDataFrame(seen[0], first.schema)
    model = langid.usual(known, langid.fit(known))
    lang, score, below = model.scores(seen[0].text.tolist())
    assert set(seen[1].doc_id) == {i for i, x, p, d in zip(seen[0].doc_id, lang, score, below, strict=True) if x != "und" and p >= 0.5 and d < 10}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()] for i in range(max(1, len(w) - 4))}
    ids, sets = seen[1].doc_id.tolist(), [grams(t) for t in seen[1].text]
    root = {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for (i, s), (j, t) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if 5 * len(s & t) >= 4 * len(s | t):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert set(seen[2].doc_id) == {find(i) for i in ids}
    own = duckdb.connect()
    own.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    own.register("documents", seen[2])
    bad = {r[0] for r in own.execute(queries.ORACLE["op2_decontamination"]).fetchall()}
    assert set(seen[3].doc_id) == set(seen[2].doc_id) - bad
    own.unregister("documents")
    own.register("documents", seen[3])
    want = own.execute(f"SELECT doc_id, copies FROM ({queries.ORACLE['op3_mixing']}) WHERE copies > 0").fetchall()
    assert sorted(zip(seen[4].doc_id, seen[4].copies, strict=True)) == sorted(want)


MIT_NOTICE = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
APACHE_NOTICE = """Copyright 2020 Someone
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD_NOTICE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice."""


@pytest.mark.parametrize("mark", ["", " * ", "# ", "-- "])
def test_licences_of_wrapped_notices(spark, mark):
    notices = {"MIT": MIT_NOTICE, "Apache-2.0": APACHE_NOTICE, "GPL-3.0": GPL_NOTICE, "BSD": BSD_NOTICE}
    texts = [("\n".join(mark + x for x in f"A title\n{t}\nand code".split("\n")), name) for name, t in notices.items()]
    parted = GPL_NOTICE.replace("Foundation,", "Foundation,\n\n").replace("useful,", "useful,\n\n")
    docs = spark.createDataFrame([(n, t) for t, n in [*texts, *((t.replace("\n", "\r\n"), n) for t, n in texts), (parted, "none")]], "doc_id string, text string")
    assert sorted((r.doc_id, r.licence, len(r.rule.split())) for r in licenses.scan(docs).collect()) == sorted(2 * [("MIT", "MIT", 3), ("Apache-2.0", "Apache-2.0", 3), ("GPL-3.0", "GPL-3.0", 2), ("BSD", "BSD", 1)])


def test_isolation_forest_isolates():
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(0, 1, (500, 3)), [[8, 8, 8]]])
    score = rules.IsolationForest(x).score(x)
    assert score.argmax() == 500


def test_junk_in_few_rows_is_rejected(spark):
    draw = random.Random(7)
    prose = lambda: " ".join("".join(draw.choice("nrtaeosl") for _ in range(draw.randrange(3, 8))) for _ in range(80))
    rows = [(i, prose()) for i in range(1000)] + [(i, " ".join(w + " ###" for w in prose().split())) for i in range(1000, 1005)]
    labels = [(i, 1) for i in range(300)] + [(1000, 0), (1001, 0)]
    judged = rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    gone = {r.doc_id for r in judged.where("not kept").collect()}
    assert set(range(1000, 1005)) <= gone and len(gone) < 15


def test_quantiles_cover_all_rows(spark):
    stats = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(rules.statistics_column(F.col("text")).alias("s")).select("s.*")
    rows = stats.toPandas()
    want = np.quantile(rules.rates(rows[~rules.base_failed(rows)]), (0.5, 0.99), axis=0)
    got = rules.quantiles(stats, (0.5, 0.99))
    assert (np.abs(np.array(got) - want) < 2e-3).all() and not np.any(rules.quantiles(stats.limit(0), (0.99,)))


def test_samples_are_bounded(spark):
    same = spark.range(5000).select(F.lit(None).cast("long").alias("id"), F.lit(3).alias("x"))
    assert rules.some(same, 100).count() <= 100
