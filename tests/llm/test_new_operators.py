"""Chunk recipes, importance resampling and the Merkle manifest against brute force and on awkward rows."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import merkle, queries, recipes, resample

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, part long, n long, key long, tree string, head long"
LONG = "".join(random.Random(4).choice("abcdefghijklmnopqrstuvwxyzß,. 漢") for _ in range(60_000))
#: Null and repeated ids, null, empty, blank and long texts, and columns named like those that the operators use inside.
ODD = [(i, t, "en", s, 3, 7, 7, 7, 7, "x", 7) for i, t, s in [(1, None, "a"), (2, "", None), (2, "", None), (9, " \n\t", "b"), (None, "One two  three", "a"), (5, "One two\nthree", "a"), (6, "onetwo three", "a"), (3, LONG, "b"), (4, LONG + " ", "b"), (8, LONG[:-1] + "!", "b"), (7, "One\x0btwothree", None), (None, None, None)]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact(rows):
    """Per row: id, id that stays, size of its group, SHA-256."""
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((str(i), str(min(groups[plain(t)])[3]), len(groups[plain(t)]), sha256(plain(t).encode()).hexdigest()) for i, t in rows))


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
def test_recipes_against_brute_force(spark, odd, key):
    """Equal groups, whatever the key: chunks whose keys collide are told apart by their texts."""
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    want = exact([(r.doc_id, r.text) for r in docs.collect()])
    for hot in (1_000, 3):  # a group may hold one in `hot` rows, and is broadcast then
        got = recipes.duplicates(docs, key=key, hot=hot).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len({plain(r.text) for r in docs.select("text").collect()})


def test_recipes_where_many_keys_collide(spark, odd):
    docs = odd.select("doc_id", "text")
    spelled = recipes.recipes(docs, key=lambda c: F.length(c).cast("long"), most=0)
    assert all(len(r["keys"]) == len(r.spelled) for r in spelled.collect())


def test_chunks_give_the_text_and_meet_again(spark):
    draw = random.Random(1)
    body = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000))
    texts = [body, "xx" + body, body[:20_000] + "Q" + body[20_000:], "漢字。" * 9_000, "z" * 20_000, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, plain string").select("i", recipes.chunks(F.col("plain")).alias("c")).collect()
    cut = {r.i: r.c for r in rows}
    assert all("".join(cut[i]) == t for i, t in enumerate(texts)) and all(1 <= len(c) <= 8192 for r in rows for c in r.c)
    for other in (1, 2):  # an inserted character changes a few chunks alone
        assert len(set(cut[0]) & set(cut[other])) >= 0.9 * len(cut[0])


def words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text):
    w = words(text)
    return Counter(crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def drawn(docs, items):
    raw, aim = Counter(), Counter()
    for total, texts in ((raw, [t for _, t in docs]), (aim, items)):
        for t in texts:
            total.update(features(t))
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda k: math.floor(1000 * math.log((aim[k] + 1) * (s + 10000) / ((raw[k] + 1) * (t + 10000))))
    rows = []
    for i, text in docs:
        found = features(text)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(k) for k, n in found.items())
        rows.append([i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = n + 1
    return sorted(str(r[:5]) for r in rows)


def test_resampling_against_brute_force(spark, odd, monkeypatch):
    docs = odd.select("doc_id", "text", "n", "part").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(1).alias("n"), F.lit(1).alias("part")))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = drawn([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    got = [str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in resample.resample(docs, items).collect()]
    assert sorted(got) == want
    assert [str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in resample.resample(docs, items.limit(0)).collect()] and not resample.resample(docs.limit(0), items).collect()


def test_streams_hold_documents_whole(spark):
    texts = ["a b c", "", None, "x y " * 30_000, "Ünï cödé 1a", "-", "d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    packed = resample.streams(docs)
    rows = packed.collect()
    assert len(rows) == 2 and [i for r in rows for i in r.ids] == list(range(7))
    for r in rows:
        found = np.frombuffer(r.stream, dtype=np.uint16)
        for i, begin, end in zip(r.ids, [0, *r.ends[:-1]], r.ends, strict=True):
            assert Counter(found[begin:end].tolist()) == features(texts[i])
    total = resample.counts(packed)
    assert total.sum() == sum(sum(features(t).values()) for t in texts)
    gain = np.arange(resample.BUCKETS, dtype=np.int64)
    assert {r.id: r.weight for r in resample.weights(packed, gain).collect()} == {i: sum(k * n for k, n in features(t).items()) for i, t in enumerate(texts)}


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The root of a list of digests and each one's path of (place, run)."""
    paths, level, above = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for path, at in zip(paths, above, strict=True):
            path.append((at % 16, runs[at // 16]))
        level, above = [h(r) for r in runs], [a // 16 for a in above]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_traversal_against_whole_trees(n):
    leaves = [h([str(i)]) for i in range(n)]
    root, want = plain_tree(leaves)
    height = next(k for k in range(4) if n <= 16**k)
    assert merkle.block_root(leaves, height) == root
    assert list(merkle.paths(leaves, height)) == want
    assert all(merkle.fold(x, p) == root for x, p in zip(leaves, want, strict=True))


def test_treehash_memory_is_logarithmic():
    for n in (256, 4096, 65536):
        height = round(math.log(n, 16))
        stack = merkle.Stack(height - 1)
        held = 0
        for i in range(n):
            stack.push(h([str(i)]))
            held = max(held, sum(map(len, stack.open)))
        assert held <= 16 * height


def leaf(r, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text))


def check_manifest(docs, got):
    by = {}
    for r in docs.collect():
        by.setdefault(r.source, []).append(((r.doc_id is not None, r.doc_id or 0), leaf(r, r.text), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: plain_tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in order}
    root, tops = plain_tree([subs[s][0] for s in order])
    want = []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for s, top in zip(order, tops, strict=True):
        for (_, own, r), path in zip(sorted(by[s], key=lambda x: x[:2]), subs[s][1], strict=True):
            bad = r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0
            node = leaf(r, r.text.translate(lower) if bad and r.text is not None else r.text)
            for place, run in path + top:
                node = h([*run[:place], node, *run[place + 1 :]])
            want.append((str(r.doc_id), own, subs[s][0], root, h(x for place, run in path + top for x in run[:place] + run[place + 1 :]), node, node == root))
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted(want)


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf(*[merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]))


def test_manifest_of_odd_rows_against_whole_trees(odd):
    check_manifest(odd, merkle.manifest(odd, tampered()).collect())
    one = odd.where("doc_id = 5")
    check_manifest(one, merkle.manifest(one, tampered()).collect())
    assert merkle.manifest(odd.limit(0)).collect() == []


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_of_a_hot_source_against_whole_trees(spark, monkeypatch, height):
    """Sources of one leaf, of one block and of several blocks; with blocks of 16 leaves the upper paths have several levels."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    source = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") < 300, F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).otherwise(F.col("id").cast("string"))
    docs = spark.range(0, 6_600 if height == 3 else 900).select(((F.col("id") * 7919) % 100_003).alias("doc_id"), source.alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    check_manifest(docs, merkle.manifest(docs, tampered()).collect())


def test_an_unchanged_row_is_verified_and_a_changed_one_is_not(spark):
    got = queries.op13_manifest(spark, SF).collect()
    changed = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if crc32(str(r.doc_id).encode()) % 5 == 0 and re.search("[A-Z]", r.text or "")}
    assert {r.doc_id for r in got if not r.verified} == changed


def test_decontamination_of_texts_that_repeat_themselves(spark):
    """A word, or a phrase, said 50,000 times meets items of that word in time that grows with the text."""
    from quirework.llm import decontaminate

    phrase = "one two three four five six seven"
    docs = spark.createDataFrame([(1, "word " * 50_000), (2, f"{phrase} " * 8_000), (3, "word " * 12), (4, "other " * 50_000), (5, f"so {phrase} it goes")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word " * 100), (2, f"{phrase} " * 10), (3, "word " * 5 + "thing " * 20)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 1): 100, (2, 2): 70, (3, 1): 100}  # 12 words are enough of a window of 13


@pytest.mark.parametrize("insults", [40, 80, 160, 400])
def test_toxicity_learns_however_wide_the_lexicon(insults):
    from quirework.llm import toxicity

    draw = random.Random(5)
    word = lambda letters, lo, hi: "".join(draw.choice(letters) for _ in range(draw.randrange(lo, hi)))
    clean, bad = [word("nrtaeosl", 3, 8) for _ in range(2000)], [word("bcdfgiklmopquvwxyz", 4, 10) for _ in range(insults)]
    text = lambda extra: " ".join([*draw.sample(clean, 20), *extra, *draw.sample(clean, 15)])
    model = toxicity.train([(text([bad[i % insults]]), 1) for i in range(1000)] + [(text([]), 0) for _ in range(1200)])
    told = lambda texts: model.probability(toxicity._Scores(model).documents(texts)) >= 0.5
    assert told([text([w]) for w in bad]).mean() >= 0.9 and told([text([]) for _ in range(400)]).mean() <= 0.02


def test_draws_are_fine_and_fragments_hold_no_query(spark):
    from quirework.llm import common, url_rules

    assert common.first_hashes(1) == 2**63 - 1 and common.first_hashes(0) == -(2**63) and common.first_hashes(1e-12) > -(2**63)
    row = spark.createDataFrame([("http://a.net/x#y?z=1",), ("http://a.net/x?q=1#y?z=1",)], "url string").select("url", *[c.alias(n) for n, c in zip(("host", "path"), url_rules.parts(F.col("url")), strict=True)])
    told = [r[0] for r in row.select(url_rules.tokens(F.col("url"), F.col("host"), F.col("path"))).collect()]
    assert not any(t.startswith("query:") for t in told[0]) and [t for t in told[1] if t.startswith("query:")] == ["query:q"]


def test_rare_words_of_chance_are_no_insults():
    """Where clean and toxic texts have as many words of their own, none of them is taken."""
    from quirework.llm import toxicity

    draw = random.Random(6)
    own = {v: Counter(f"^{draw.randrange(10**6):06d}{v}$" for _ in range(3000)) for v in "ab"}
    assert toxicity.rare(own["a"], own["b"], [], 0.9) == []


GPL = "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."
NOTICES = {
    "gpl2": (GPL, {"GPL-2.0-or-later"}),
    "agpl": (GPL.replace("GNU General", "GNU Affero General").replace("version 2", "version 3"), {"AGPL-3.0-or-later"}),
    "lgpl": (GPL.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1"), {"LGPL-2.1-or-later"}),
    "gpl2 only": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", {"GPL-2.0-only"}),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", {"ISC"}),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", {"MPL-2.0"}),
    "unlicense": ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
    "boost": ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", {"BSL-1.0"}),
    "tag": ("// SPDX-License-Identifier: GPL-3.0-or-later", {"GPL-3.0-or-later"}),
    "title": ("MIT License\n\nCopyright (c) 2020 Someone", {"MIT"}),
    "named": ("Licensed under the MIT License.", {"MIT"}),
    "cc": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"CC-BY-4.0"}),
    "eclipse": ("Copyright (c) 2009 Someone and others. All rights reserved.\nThis program and the accompanying materials are made available under the\nterms of the Eclipse Public License v1.0 which accompanies this\ndistribution, and is available at\nhttp://www.eclipse.org/legal/epl-v10.html", {"EPL-1.0"}),
    "reserved": ("Copyright 2020 Someone. All rights reserved.", {"proprietary"}),
    "bsd": ("Copyright (c) Someone. All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n* Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"BSD", "BSD-3-Clause"}),
    "none": ("The license of the poet is free, and the program is software.", set()),
}


@pytest.mark.parametrize("mark", ["", " * "])
def test_notices_of_many_licences(spark, mark):
    from quirework.llm import licenses

    docs = spark.createDataFrame([(n, "\n".join(mark + x for x in t.split("\n"))) for n, (t, _) in NOTICES.items()], "doc_id string, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.licence)
    assert got == {n: want for n, (_, want) in NOTICES.items() if want}
