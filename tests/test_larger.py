"""What must not be moved or kept as tables grow, by plans, and the same results."""

import json
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quirework.functions import arrays
from quirework.functions import text as tx
from quirework.operators import aligned, citations, compare, curation, divisions, intervals, order, refind, sequences
from quirework.plans import catalog, queries
from quirework.plans import editions as editions_plans
from quirework.sources import archives, dictionaries, editions, markup

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_segments_are_told_without_a_join(spark):
    spans = [(1, 0, 10), (1, 4, 6), (1, 4, 6), (1, 8, 8), (1, 9, 3), (1, 12, None), (1, 20, 25), (None, 1, 2), (2, 5, 5), (3, 1, 2)]
    got = intervals.segments(spark.createDataFrame(spans, "node int, start int, end int"), ["node"])
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, 1), (1, 3, 4, 1), (1, 4, 6, 3), (1, 6, 8, 1), (1, 8, 9, 1), (1, 9, 10, 1), (1, 20, 25, 1), (3, 1, 2, 1)]
    assert got.columns == ["node", "start", "end", "layers"] and "Join" not in plan(got)


def test_lines_of_suppliers_are_dealt_to_tasks_by_their_rows(spark):
    rows = spark.range(1000).selectExpr("id % 100 as k", "id")
    assert order.dealt(rows, ["k"], 50).rdd.getNumPartitions() == 20 and order.dealt(rows, ["k"]).count() == 1000
    assert re.search(r"RepartitionByExpression \[l_suppkey#\w+\], 4\b", plan(catalog.best_scene(spark, SF)))


def test_works_are_judged_before_their_links_are_moved(spark):
    works = spark.createDataFrame([(1, "A", 1900, "h"), (2, "a", 1950, "x"), (3, "b", 1960, "x"), (4, "c", None, "h"), (5, "d", 1970, "h"), (6, "e", 1980, "h")], "work int, title string, year int, field string")
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (1, 4), (2, 2), (2, 5), (9, 4), (None, 4), (1, 6), (2, 6), (3, 6), (4, 6)], "line int, work int")
    shown = curation.quotation_links(works, links, spark.createDataFrame([(1,), (1,), (2,), (3,)], "line int"), works.where("work = 5").select("work"), F.lower(F.col("title")), "h", 10, 0.4)
    assert sorted(map(tuple, shown.collect())) == [(1, 1, 1), (1, 2, 4), (2, 1, 1)]
    assert not re.search(r"Aggregate \[line#\w+\], \[line#\w+\]", plan(shown))


def test_grams_that_no_item_holds_go_before_the_distinct_ones_are_sought(spark):
    assert plan(queries.rare_trigrams(spark, SF)).split("Join", 1)[0].count("Aggregate ") == 2


def test_forms_of_words_are_not_kept_and_candidates_without_their_quotations(spark, monkeypatch):
    tables, keep = [], citations.kept
    monkeypatch.setattr(citations, "kept", lambda df: tables.append(df.columns) or keep(df))
    lines = spark.createDataFrame([("s", i, i, ["the", f"kings{i}", "crown", "gold"]) for i in range(4)], "scene string, idx int, number int, words array<string>")
    cites = spark.createDataFrame([(1, "s", 2, "kings2", ["crown", "gold"])], "id int, scene string, line int, head string, quote array<string>")
    assert [tuple(r)[:4] for r in citations.match(lines, cites).collect()] == [(1, "s", 2, 1)]
    # of the tables of several rows a citation or line, none holds forms or arrays
    assert not [t for t in tables if "at" in t and ("quoted" in t and "_reason" not in t or "head" in t and "id" not in t)]


def test_places_by_the_index_and_one_by_one():
    draw = random.Random(3)
    for letters in ("ab", "aé漢😀\n", "a"):
        text = "".join(draw.choice(letters) for _ in range(400))
        quotes = list({text[p : p + n] for p in range(0, 390, 7) for n in (1, 2, 3, 4, 7, 8, 9, 30)} | {"zz", text + "a", "b" * 9})
        plain = {x: [p for p in range(len(text)) if text.startswith(x, p)] for x in quotes}
        assert plain == {x: p.tolist() for x, p in refind.places(text, quotes, 0).items()} == {x: p.tolist() for x, p in refind.places(text, quotes, 10_000).items()}


def test_lost_anchors_move_no_grams_and_each_text_once(spark):
    """Lines far longer than a gram and many anchors on one text: rows that move are the nodes and anchors alone."""
    nodes = spark.createDataFrame([(1, i, f"{i} said it so " + "x" * (200_000 if i == 7 else 5) + f" end {i}") for i in range(3000)], "doc int, idx int, text string")
    stored = spark.createDataFrame([(i, 1, 0, 0, 0, 1, f"x end {i}", "", "\n") for i in range(100, 3000)] + [(3001, 1, 0, 0, 0, 1, "so", "7 said it ", " xxxxxx")], "id int, doc int, start_idx int, start_off int, end_idx int, end_off int, exact string, prefix string, suffix string")
    told = refind.found(stored, nodes, "doc")
    assert "sequence(" not in plan(told) and plan(told).count("Generate ") == 1
    got = {r.id: tuple(r)[1:] for r in told.collect()}
    # a number that others begin with occurs in their lines too, and a line end in surroundings agrees with nothing
    want = {i: (i, len(f"{i} said it so xxxxx") - 1, i, len(f"{i} said it so xxxxx end {i}")) for i in range(300, 3000)}
    assert {i: p for i, p in got.items() if 300 <= i < 3000} == want and not [i for i in got if 100 <= i < 300] and got[3001] == (7, 10, 7, 12)


def test_references_are_told_in_their_sense_and_headwords_in_their_book(spark):
    texts = spark.createDataFrame([(1, "so it.\x85 Hml.\u3000III,\u00a01, 76 ; 77, 78. x, IIII, 5, 6, 7, 8")], "k int, text string")
    told = dictionaries.first_citations(texts, ["k"])
    assert sorted(tuple(r)[1:] for r in told.collect()) == [(0, "Hml", 3, 1, None, 76, "so it\x85"), (1, "Hml", 3, 1, None, 77, ""), (2, "Hml", 3, 1, None, 78, ""), (3, "Hml", 3, 5, None, 6, "x"), (4, "Hml", 3, 5, None, 7, ""), (5, "Hml", 3, 5, None, 8, "")]
    words = spark.createDataFrame([(1, 2, "b", None), (1, 1, "c", "x"), (1, 3, "b", "y"), (2, 0, "z", "")], "book int, p int, key string, body string")
    chain = dictionaries.alphabetical(words, "book", "p", "key")
    assert sorted(map(tuple, chain.collect())) == [(1, 2, "b", None), (1, 3, "b", "y"), (2, 0, "z", "")]
    assert not re.search("Window|Join|Aggregate", plan(told)) and "InPandas" not in plan(chain)


def test_archives_are_no_table_each_and_few_large_ones_no_batch():
    rows = pa.RecordBatch.from_pydict({"path": ["a", "b", None, "d"], "n": ["x" * 9, "y", None, "z" * 5]})
    of = arrays.batched(lambda path, n: (path, n), rows.schema, 8)
    assert [b.to_pydict()["path"] for b in of(iter([rows, rows.slice(0, 0)]))] == [["a"], ["b", None, "d"]]
    many = pa.RecordBatch.from_pydict({"path": ["a"] * 1200})
    assert [len(b) for b in arrays.batched(lambda p: (p,), many.schema)(iter([many]))] == [500, 500, 200]


def test_the_items_of_an_array_are_not_read_for_its_type(spark):
    made = [json.dumps({"definitions": d}) for d in ([], [1, "a", {"b": []}], {}, None, "[]", 3)] + ["{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string").withColumn("v", F.try_parse_json("t"))
    assert [r[0] for r in df.orderBy("i").select(archives._items(F.col("v"), "$.definitions").isNotNull()).collect()] == [True, True] + [False] * 5
    assert [r[0] for r in df.orderBy("i").select(archives._each(F.col("v"), "$.definitions", lambda x: x.isNotNull())).collect()] == [True, True] + [False] * 5
    notes = archives.read(archives.written(spark.createDataFrame([("p", "q", "c", "", {"v": "r"})], "path string, play string, collection string, exported_at string, versions map<string,string>"), spark.createDataFrame([], "path string, kind string, n int, record string")))[0]
    assert notes.first().whole and "InPandas" not in notes._jdf.queryExecution().toString()


def test_curated_entries_are_put_in_their_text_and_tasks_hold_bounded_rows(spark):
    schema = "d int, entry int, orig array<int>, modern array<int>, relation string"
    entries = spark.createDataFrame([(1, 0, [0, None], [0], "same"), (1, 1, [1, 2], [], None), (1, 2, [3], [3, 4], "same"), (2, 5, [0], None, "same"), (None, 0, [9], [9], "same")], schema)
    curated = spark.createDataFrame([(1, 7, [2, 3], [4], "variant"), (1, 8, [0], [], "variant")], schema.replace("entry", "k"))
    done = curation.curated_alignment(entries, curated, "d")
    assert sorted(map(tuple, done.collect()), key=str) == sorted([
        (1, 0, 1, [0], [], "variant", "reviewed"), (1, 0, 2, [None], [], "orig-only", "auto"), (1, 0, 3, [], [0], "modern-only", "auto"),
        (1, 1, 1, [2, 3], [4], "variant", "reviewed"), (1, 1, 2, [1], [], "orig-only", "auto"), (1, 2, 1, [], [3], "modern-only", "auto"),
        (2, 5, 1, [0], None, "same", "auto"), (None, 0, 1, [9], [9], "same", "auto"),
    ], key=str)
    assert "RepartitionByExpression [d#" in plan(done) and "Window" not in plan(done)


def test_chains_are_told_in_a_row_and_no_table_each(spark):
    rows = [("x", 1, 5, 50), ("x", 2, 3, 20), ("x", 3, 6, 30), ("x", 3, 9, 25), ("y", 4, 1, 7), ("y", 4, 1, 7), ("y", 5, 8, 6)]
    pairs = spark.createDataFrame(rows, "d string, i int, a int, b int")
    chained = sequences.chains(pairs.withColumn("i", F.lit(0)), ["d", "i"], "a", "b")
    assert chained.columns == ["d", "i", "a", "b"] and "InPandas" not in plan(chained)
    assert sorted(tuple(r)[2:] for r in chained.where("d = 'x'").collect()) == [(3, 20), (9, 25)]
    assert chained.where("d = 'y'").count() == 1 and sequences.chains(pairs.limit(0), ["d", "i"], "a", "b").count() == 0


def test_events_tell_their_level_and_plays_are_told_without_windows_over_them(spark):
    text = '<x:a n="1">s<floatingText><body><div type="text" k="v"><sp>t<l>u</l></sp></div></body></floatingText></x:a>'
    stream = markup.events(spark.createDataFrame([("f", text.encode())], "path string, content binary"))
    told = [(r.at, r.event[0], r.tag or r.text, r.level, r.begun, r.within) for r in stream.collect()]
    assert told[:3] == [(0, "s", "a", 1, 0, " a "), (1, "t", "s", 1, 0, " a "), (2, "s", "floatingText", 2, 2, " a floatingText ")]
    assert told[-6:-4] == [(9, "e", "l", 6, 7, " a floatingText body div sp l "), (10, "e", "sp", 5, 5, " a floatingText body div sp ")]
    assert [r.attributes for r in stream.where("at in (0, 13, 14)").orderBy("at").collect()] == [{"n": "1"}, {}, {"n": "1"}]
    play = editions.early_play(stream)
    # elements about the play count neither for levels nor for tags
    assert [(r.at, r.level, r.within) for r in play.where("event = 'start'").orderBy("at").collect()] == [(4, 0, " div "), (5, 1, " div sp "), (7, 2, " div sp l ")]
    assert "Window" not in plan(play) and [tuple(r)[2:4] for r in editions.early_nodes(play, editions.early_scenes(play)).collect()] == [(0, "line")]


def test_lost_quotations_are_sought_in_blocks_of_lines_and_no_word_is_moved(spark, monkeypatch):
    """Blocks of a few lines and rows of few citations give what plain loops do."""
    monkeypatch.setattr(citations, "LINES", 40)
    monkeypatch.setattr(citations, "CITES", 3)
    draw = random.Random(5)
    says = [f"{a}{b}{c}" for a in "abc" for b in "aei" for c in ("", "r", "rst", "rstuv")]
    lines = [(s, i, i, [draw.choice(says) for _ in range(draw.randint(0, 7))]) for s in "stuvw" for i in range(1, 60, 2)]
    cites = [(i, "x", i, draw.choice(says), list(dict.fromkeys(draw.choice(says) for _ in range(draw.randint(2, 7))))) for i in range(60)]
    rows = spark.createDataFrame(lines, "scene string, idx int, number int, words array<string>")
    asked = citations.with_quotes(spark.createDataFrame(cites, "id int, scene string, line int, head string, quote array<string>")).cache()
    form = lambda w, h: w.startswith(h) and len(w) - len(h) <= 3
    beside = lambda k: {w for j in (k - 1, k, k + 1) if 0 <= j < len(lines) and lines[j][0] == lines[k][0] for w in lines[j][3]}
    want = {}
    for c in asked.where("size(quoted) >= 3").collect():
        met = [k for k, x in enumerate(lines) if any(form(w, c.head) for w in x[3]) and len(set(c.quoted) & beside(k)) >= c.needed]
        if len(met) == 1:
            want[c.id] = (*lines[met[0]][:2], next(n for n, w in enumerate(lines[met[0]][3]) if form(w, c.head)))
    scenes = citations.in_scenes(rows)
    got = citations.recovered(asked, scenes)
    assert want and {r.id: tuple(r)[1:] for r in got.collect()} == want and "Generate explode(words" not in plan(got)
    every = asked.select("id").crossJoin(rows.select("scene").distinct())
    assert {r.id: tuple(r)[1:] for r in citations.recovered(asked, scenes, every).collect()} == want
    assert citations.recovered(asked, scenes.limit(0)).count() == citations.recovered(asked.limit(0), scenes).count() == 0


def test_keys_in_kernels_are_those_of_columns(spark):
    draw = random.Random(2)
    words = [f"a{chr(c)}b" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + [f"{chr(c)}ed" for c in range(0xA000, 0x1F000, 7) if not 0xD800 <= c < 0xE000]
    words += ["".join(draw.choice("aeedckkttpxsvujyſÉn̄ßΣİ'’.1") for _ in range(draw.randint(0, 9))) for _ in range(5000)]
    keys = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.word_key(F.col("w")).alias("k")).collect()
    assert [r for r in keys if tx.key(r.w) != r.k] == []


def test_differences_move_texts_alone_and_once_a_side(spark):
    nodes = spark.createDataFrame([(1, 0, "so—& the 12 Kings\u00a0, said"), (1, 1, None), (1, 2, " - x")], "doc int, idx int, text string")
    other = spark.createDataFrame([(1, 0, "fo & kings say"), (1, 5, "ye")], "doc int, idx int, text string")
    rows = spark.createDataFrame([(1, 1, [0], [0, 5]), (1, 2, [1, 2, 9], []), (1, 3, [], None), (2, 1, [0], [0])], "doc int, place int, left array<int>, right array<int>")
    told = compare.differences(rows, nodes, other, "doc")
    assert sorted(tuple(r)[1:] for r in told.collect()) == [(1, "left", 0, 0, 2), (1, "left", 0, 5, 8), (1, "left", 0, 20, 24), (1, "right", 0, 0, 2), (1, "right", 0, 11, 14), (1, "right", 5, 0, 2), (2, "left", 2, 3, 4)]
    exact = compare.differences(rows, nodes, other, "doc", True)
    assert sorted(tuple(r)[1:] for r in exact.where("side = 'left'").collect()) == [(1, "left", 0, 0, 2), (1, "left", 0, 5, 8), (1, "left", 0, 9, 11), (1, "left", 0, 12, 19), (1, "left", 0, 20, 24), (2, "left", 2, 3, 4)]
    assert len(re.findall("Join ", plan(told))) == 2 and "regexp_extract_all" not in plan(told)


def test_texts_of_split_scenes_are_moved_once(spark):
    """What is told of a document stays where the document is; words, landmarks and scenes were moved each."""
    told = editions_plans.scene_pieces(spark, SF)
    exchanges = re.findall(r"Exchange hashpartitioning\(.*?, (\w+), \[plan_id", told._jdf.queryExecution().executedPlan().toString())
    assert set(exchanges) == {"REPARTITION_BY_NUM"} and told.count() > 1000


def test_nodes_of_aligned_versions_are_not_moved_for_their_scenes(spark, monkeypatch):
    tables, keep = [], aligned.kept
    monkeypatch.setattr(aligned, "kept", lambda df: tables.append(df) or keep(df))
    editions_plans.aligned_versions(spark, SF)
    blocks = next(t for t in tables if "relation" in t.columns)._jdf.queryExecution().executedPlan().toString()
    # all that is dealt again is dealt by document, so the nodes, which are, stay where they are
    assert {re.sub("#.*", "", c) for c in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", blocks)} == {"doc_id"} and not re.search("Exchange hashpartitioning\\([^)]*, [^)]*, ", blocks)


def test_places_between_landmarks(spark):
    chain = F.expr("array(named_struct('orig', 4, 'modern', 2), named_struct('orig', 9, 'modern', 4), named_struct('orig', 10, 'modern', 9))")
    got = spark.range(12).select(divisions.counterpart(F.col("id").cast("int"), chain).alias("p"), divisions.counterpart(F.col("id").cast("int"), F.slice(chain, 1, 0)).alias("none")).collect()
    assert [r.p for r in got] == [0, 2, 4, 7, 9, 9, 9, 10, 10, 10, 11, 12] and [r.none for r in got] == list(range(12))


def test_keys_of_texts_are_those_of_their_words(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("aeedckktxpssvujyiſÉéñΣİßﬁ&-—– \t\n\x0b\f\r ’.1́😀CEDT") for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    words = F.filter(F.transform(tx.pieces(F.replace("t", F.lit("&"), F.lit(" and "))), tx.word_key), lambda k: k != "")
    assert spark.createDataFrame([(t,) for t in texts], "t string").where(tx.keys(F.col("t")) != words).count() == 0
