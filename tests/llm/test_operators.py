"""Each training-data operator on small tables: defined cases and brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import components, decontaminate, license_scan, mixing, ngram_join, passages, quality_classifier, quality_rules, sharding, token_shards, warc
from corpusloom.llm import common
from corpusloom.llm.common import new_path, tokens, words, written

DOCS = "doc_id bigint, text string, lang string, source string, extra string"


def docs(spark, texts, source=lambda i: f"s{i % 2}"):
    rows = [(i, t, "en", source(i), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- 1


def brute_contamination(texts, items, window=10):
    pats = defaultdict(set)
    for k, t in items:
        w = words(t.encode()) if t else []
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            pats[tuple(w[i : i + n])].add(k)
    out = []
    for t in texts:
        w = words(t.encode()) if t else []
        hit, found = set(), set()
        for p, ks in pats.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= ks
        out.append((len(w), len(hit), sorted(str(k) for k in found if k is not None)))
    return out


def test_decontaminate(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 12, 10, 4, 1))] + [(5, None), (6, ""), (7, "!!"), (None, "null item words here"), (8, None)]
    long = items[0][1]
    texts = [None, "", "...", long, long.upper().replace(" ", ", "), prose(rng, 50) + " " + items[1][1] + " " + prose(rng, 20), long[5:], items[3][1], "x " + items[4][1] + " y", "a null item words here b", prose(rng, 30000, 50) + " " + items[2][1], "é" + items[3][1], long]
    d, b = docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contamination(texts, items)
    for block in (decontaminate.BLOCK_CHARS, 400):
        got = decontaminate.scan(d, b, block_chars=block).orderBy("doc_id").collect()
        assert [(r.contamination.n_words, len(r.contamination.hits), r.contamination.items) for r in got] == want
        assert got[0].extra == "x"
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {i for i, x in enumerate(want) if not x[1]}
    at = decontaminate.scan(d, b).withColumn("spans", decontaminate.spans(F.col("text"), F.col("contamination.hits"))).orderBy("doc_id").collect()
    assert [texts[5][s.start : s.end] for s in at[5].spans] == [items[1][1]]
    digest = decontaminate.scan(d, b).select("doc_id", *decontaminate.digest(F.col("contamination"))).orderBy("doc_id").first()
    assert digest.items_sha256 == hashlib.sha256(b"").hexdigest() and not digest.contaminated
    assert decontaminate.scan(d.limit(0), b).count() == 0
    assert decontaminate.scan(d, b.limit(0)).filter(F.size("contamination.hits") > 0).count() == 0
    clash = d.withColumns({"contamination": F.lit(1), "key": F.lit(2)})
    for block in (decontaminate.BLOCK_CHARS, 400):
        got = decontaminate.scan(clash, b, block_chars=block)
        assert got.columns == [*clash.columns, "contamination_"] and got.agg(F.sum("contamination"), F.sum("key")).first() == (len(texts), 2 * len(texts))
    assert decontaminate.drop_contaminated(clash, b).columns == clash.columns


# --- 2


def test_quality_classifier(spark, data):
    folder = data.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_classifier.fit_on_train(d, labels)
    scored = d.withColumn("s", quality_classifier.score(model, F.col("text"))).withColumn("held", quality_classifier.held_out(F.col("doc_id")))
    held = scored.filter("held").join(labels, "doc_id").collect()
    assert len(held) > 50
    assert np.mean([(r.s >= 0.3) == bool(r.quality) for r in held]) >= 0.95
    assert all(0 <= r.s <= 1 for r in held)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held for r in scored.limit(50).collect())
    odd = docs(spark, [None, "", "a", "word " * 40000]).withColumn("s", quality_classifier.score(model, F.col("text"))).orderBy("doc_id").collect()
    assert all(0 <= r.s <= 1 for r in odd) and odd[0].s == odd[1].s
    again = quality_classifier.fit_on_train(d, labels)
    assert again == model
    # The mean score is the share of label 1 among the labels, whatever the bound on rows.
    train = labels.filter(~quality_classifier.held_out(F.col("doc_id")))
    rate = train.agg(F.avg("quality")).first()[0]
    for rows in (60, 2000):
        some = quality_classifier.fit_on_train(d, labels, rows=rows)
        mean = d.join(train, "doc_id").agg(F.avg(quality_classifier.score(some, F.col("text")))).first()[0]
        assert abs(mean - rate) < 0.03, (rows, mean, rate)
    assert d.limit(0).withColumn("s", quality_classifier.score(model, F.col("text"))).count() == 0
    twice = d.limit(20).unionByName(d.limit(20)).withColumn("i", F.lit(1)).withColumn("s", quality_classifier.score(model, F.col("text")))
    assert twice.groupBy("doc_id").agg(F.count_distinct("s").alias("n")).filter("n > 1").count() == 0
    none = quality_classifier.fit_on_train(d, labels.limit(0))
    assert quality_classifier.score_text(none, b"x") == 0.5
    assert spark.createDataFrame([(None,)], "doc_id bigint").select(quality_classifier.held_out(F.col("doc_id"))).first()[0] is False


# --- 3


def brute_components(texts, width=4, percent=85):
    sets = []
    for t in texts:
        w = tokens(t.encode()) if t else []
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("options", [{}, {"hot": 2, "block": 4, "short": 2, "size": 3, "rounds": 1}, {"hot": 2, "max_hot": 1, "block": 2, "short": 3, "size": 2, "rounds": 0}])
def test_ngram_join(spark, options):
    rng = random.Random(len(options))
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "one  two three", "a b c d", "a b c d"]
    for _ in range(6):
        base = prose(rng, rng.randrange(30, 90))
        texts += [base] * 3 + [near(rng, base, rng.randrange(4)) for _ in range(6)] + [base.upper().replace(" ", "\n")]
    passage = prose(rng, 12)
    texts += [f"{passage} {prose(rng, 40)}" for _ in range(10)] + [f"{passage} {i}" for i in range(5)] + [prose(rng, 20000)]
    # Chains in which only neighbours link, and copies of which few link with each other.
    walk = prose(rng, 80).split()
    for i in range(12):
        walk[6 * i] = f"step{i}"
        texts.append(" ".join(walk))
    texts += [near(rng, base, 3) for _ in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs(spark, texts), **options).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    if not options:
        kept = sorted(r.doc_id for r in ngram_join.keep_one(docs(spark, texts)).collect())
        assert kept == sorted({c for _, c in brute_components(texts)})


def test_ngram_join_near_copies_stay_linear(spark, monkeypatch):
    """Pairs that blocks multiply, and owners in a block, for near copies of one text."""
    seen = []
    real = ngram_join._blocks

    def counted(candidates, block):
        out = real(candidates, block)
        seen.append((candidates.agg(F.sum(F.size("others"))).first()[0] or 0, out.groupBy("block").agg(F.count_distinct("owner").alias("n")).agg(F.max("n")).first()[0] or 0))
        return out

    monkeypatch.setattr(ngram_join, "_blocks", counted)
    rng, n = random.Random(33), 800
    base = prose(rng, 60)
    got = ngram_join.join(docs(spark, [base] + [near(rng, base, 1) for _ in range(n)]), block=64)
    assert {r.component_id for r in got.collect()} == {0}
    assert sum(pairs for pairs, _ in seen) <= 5 * n and max(most for _, most in seen) <= 128


def test_ngram_join_order_is_one_number_each(spark, monkeypatch):
    """Of the frequent n-grams only the hashes go through the driver, the most frequent one first."""
    asked, frame = [], type(spark.range(0))
    real = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: asked.append(self.columns) or real(self))
    docs = spark.createDataFrame([(i, "a b c d e f g " + "h i j k " * (i % 2) + f"x{i}") for i in range(12)], "doc_id bigint, text string")
    assert len({r.component_id for r in ngram_join.join(docs, hot=3, percent=50).collect()}) == 2
    assert asked == [["fp"]]
    order = ngram_join.Order(np.array([70, 10, 30]), 32)
    assert order.fp.tolist() == [10, 30, 70] and order.rank.tolist() == [1, 0, 2]


def test_steps_leave_no_garbage_on_the_driver(spark, monkeypatch):
    """A step that ends with a heap grown beyond its share drops what it has left there."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())
    for most, more in ((0.0, 1), (1.0, 0)):
        monkeypatch.setattr(common, "MOST_HEAP", most)
        before = whole()
        assert written(spark.range(10), "ten").count() == 10
        assert whole() == before + more


def test_ngram_join_odd_tables(spark):
    d = docs(spark, ["a b c d e", "a b c d e"])
    assert ngram_join.join(d.limit(0)).count() == 0
    twice = d.unionByName(d).unionByName(spark.createDataFrame([(None, "a b c d e", "en", "s", "x")], DOCS))
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.join(twice).collect())
    assert got == {(0, 0): 2, (1, 0): 2, (None, None): 1}
    assert ngram_join.keep_one(twice).count() == 2
    clash = d.limit(1).unionByName(d.limit(1).withColumn("text", F.lit("other words are here now"))).withColumns({"id__": F.lit(1), "row__": F.lit(2), "n": F.lit(3)})
    (one,) = ngram_join.keep_one(clash).collect()
    assert one.text == "a b c d e" and one.row__ == 2 and ngram_join.keep_one(clash).columns == clash.columns


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2001)] * 2
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(n, n) == root(n) for n in list(parent))
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 4


def license_text(t):
    return b" " + b" ".join(words(t.encode())) + b" "


def brute_base(t):
    """(word, label) of each base phrase, by comparing words."""
    w = words((t or "").encode())
    return sorted((i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.encode().split())


def test_license_scan(spark):
    texts = [None, "", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0", "Released under the MIT License. mit license MIT-LICENSE", "mit freundlichen", "x " * 20000 + "BSD 3-Clause", "cc by cc by"]
    got = docs(spark, texts).select("doc_id", *license_scan.digest(license_scan.scan(F.col("text")))).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got] == [
        (0, None, None, "", ""), (0, None, None, "", ""), (1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0"), (1, 6, 6, "gpl", "gpl,gpl-3.0"),
        (0, None, None, "", "apache-2.0"), (3, 3, 7, "mit", "mit"), (0, None, None, "", ""), (0, None, None, "", "bsd-3-clause"), (2, 0, 2, "cc-by", "cc-by"),
    ]
    assert all(0 <= r.score <= 1 for r in got) and got[4].score == 1.0 and got[0].score == 0.0
    assert docs(spark, []).select(license_scan.scan(F.col("text"))).count() == 0


def test_license_scan_over_the_corpus(spark, data):
    """Base places of every document by comparing words, and its detections without the prefilter and by all pairs."""
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", license_scan.scan(F.col("text")).alias("r"))
    rows = d.select("doc_id", "text", "r", *license_scan.digest(F.col("r"))).collect()
    for r in rows:
        base = brute_base(r.text)
        assert [(b.word, b.label) for b in r.r.base] == base and r.n_base == len(base) and r.n_words == len(words((r.text or "").encode()))
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in base})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert [(f.start, f.end) for f in r.r.found] == [x[1:] for x in license_scan.detections(license_text(r.text or ""), gated=False)]


LICENSES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance",
    "gpl-3.0": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "gpl-2.0": "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "lgpl-2.1": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "agpl-3.0": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl": "The accompanying program is provided under the terms of this Eclipse Public License",
    "zlib": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-sa-4.0": "SPDX-License-Identifier: CC-BY-SA-4.0",
    "cc-by-nc-nd": "under a Creative Commons Attribution-NonCommercial-NoDerivatives International License",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "wtfpl": "You just DO WHAT THE FUCK YOU WANT TO.",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "json": "The Software shall be used for Good, not Evil.",
}


def test_license_rules():
    rules = license_scan.rules()
    assert len(rules) == len({r.pattern for r in rules}) >= 250
    for label, t in LICENSES.items():
        text = license_text(f"été du code\n{t}\nréservés")
        found = [rules[i].label for i, _, _ in license_scan.detections(text)]
        assert label in found, (label, found)
        assert license_scan.detections(text) == license_scan.detections(text, gated=False)
    for r in rules:
        # The keyword is among the words that no match can lack.
        needed = r.pattern.pattern.decode()
        while (shorter := re.sub(r"\(\?:[^()]*\)(\?|\{0,\d+\}\??)", "", needed)) != needed:
            needed = shorter
        assert r.keyword.strip() in needed, r


def test_license_suppression():
    rng = random.Random(4)
    for _ in range(200):
        found = [(rng.randrange(3), i, a := rng.randrange(30), a + rng.randrange(1, 8)) for i in range(25)]
        want = [x for x in found if not any(y != x and y[2] <= x[2] and x[3] <= y[3] and (y[0] > x[0] or y[0] == x[0] and ((y[2], y[3]) != (x[2], x[3]) or y[1] < x[1])) for y in found)]
        assert license_scan.suppressed(found) == sorted(want, key=lambda x: (x[2], x[3], x[1]))
    began = time.perf_counter()
    long = license_scan.scan_text(b"cc by under the terms of the gnu general public license " * 100_000)
    assert long["n_words"] == 1_100_000 and len(long["base"]) == 200_000 and time.perf_counter() - began < 60


# --- 5


def test_sharding(spark):
    names = [f"n{i}" for i in range(16)]
    size = sharding.table_size(16)
    slots = sharding.lookup_table(names, size)
    counts = Counter(slots)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], size)
    moved = sum(a != b for a, b in zip(slots, fewer, strict=True) if a != 15)
    assert moved < 0.1 * size
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    d = d.unionByName(d.limit(3)).unionByName(spark.createDataFrame([(None, "s")], "doc_id bigint, source string"))
    got = sharding.assign(d, names, ["doc_id"])
    rows = got.collect()
    assert len(rows) == 5004 and all(r.shard == names[slots[r.slot]] for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == 5001
    assert sharding.assign(d.limit(0), names, ["doc_id"]).count() == 0
    again = sharding.assign(got, names, ["doc_id"])
    assert again.columns == [*got.columns, "slot_", "shard_"] and again.filter("shard <> shard_ or slot <> slot_").count() == 0
    pairs = spark.createDataFrame([("a", None), (None, "a"), ("a", "")], "x string, y string")
    a, b, c = (r.slot for r in sharding.assign(pairs, names, ["x", "y"]).collect())
    assert a != b and a == c
    path = new_path(spark, "shards")
    sharding.write_shards(got, path)
    assert spark.read.parquet(path).count() == 5004


# --- 6


def brute_counts(t):
    w = tokens((t or "").encode())
    lines = [x for x in (t or "").split("\n") if tokens(x.encode())]
    each = (t or "").split()
    grams = Counter(tuple(each[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(each[i : i + 3])] > 1 for k in range(3)}
    return (len(w), len("".join((t or "").split())), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))


def brute_verdicts(rows):
    """kept of (text, lang, source) rows, by the rules as the module states them."""
    R = quality_rules
    each = []
    for t, lang, source in rows:
        n, chars, symbols, dup, rep = brute_counts(t)
        lines = len([x for x in (t or "").split("\n") if x.split()])
        each.append({"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep, "n_lines": lines, "lang": lang, "source": source, "text": t or ""})
    distinct = {(e["lang"], e["source"], e["text"]): e for e in each if e["n_words"]}.values()

    def quantiles(share, group):
        n, of, unit = R.SHARES[share]
        v = sorted(min(R.MAX_STEP, unit * e[n] // e[of]) for e in group)
        return len(v), [v[-(-len(v) * p // 100) - 1] for p in R.QUANTILES]

    def drawn(share, group, towards):
        n, q = quantiles(share, group)
        return [(n * a + R.PULL * b) / (n + R.PULL) for a, b in zip(q, towards, strict=True)]

    out = []
    for e in each:
        kept = e["n_words"] >= 50 and 2 * e["n_repeat_words"] <= e["n_words"]
        usual = {}
        for k in R.SHARES if kept else ():
            lang = drawn(k, [x for x in distinct if x["lang"] == e["lang"]], quantiles(k, distinct)[1])
            own = drawn(k, [x for x in distinct if (x["lang"], x["source"]) == (e["lang"], e["source"])], lang)
            usual[k] = own[1] if k == "width" else min(own[1] + R.FENCES * (own[1] - own[0]), R.BOUND * lang[2])
        for k in R.RULES if kept else ():
            n, of, unit = R.SHARES[k]
            rate, w = usual[k] * e[of] / unit, 2 * usual["width"] if k == "repeats" else 1
            kept = kept and e[n] <= rate + R.SIGMAS * (rate * w + w * w) ** 0.5
        out.append(kept)
    return out


def test_quality_rules(spark):
    rng = random.Random(6)
    line = " ".join(f"l{i}" for i in range(12))
    clean = [prose(rng, 80) for _ in range(60)] + [f"{line}\n{prose(rng, 70)}\n{line}\n{prose(rng, 30)}" for _ in range(20)]
    code = [" ".join(f"v{rng.randrange(900)} {rng.choice('#*$<>')}" for _ in range(60)) for _ in range(40)]
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "x\nx\n \nx y", "é ü # * $", prose(rng, 60) + " ###" * 60, "same line here\n" * 40 + prose(rng, 60), prose(rng, 20000)] + clean
    rows = [(t, "en", None if i % 3 == 0 else "s") for i, t in enumerate(texts)] + [(t, "en", "code") for t in code] + [(code[0], "fr", "code"), (prose(rng, 60), None, "t")]
    # A group in which copies of one junk text are the most, and one that junk fills.
    rows += [("junk ## " * 60, "en", "copies")] * 50 + [(prose(rng, 90), "en", "copies") for _ in range(20)]
    rows += [(" ".join(f"j{rng.randrange(900)} ####" for _ in range(60)), "en", "dirty") for _ in range(6)]
    d = spark.createDataFrame([(i, *r, 1, 1) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_words int, text__ int")
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    for i, (t, _, _) in enumerate(rows):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert [got[i].kept for i in range(len(rows))] == brute_verdicts(rows)
    n, m = len(texts), len(code)
    assert not got[7].kept and not got[8].kept and all(got[i].kept for i in range(9, n))
    # Many symbols are usual in one source only.
    assert all(got[i].kept for i in range(n, n + m)) and not got[n + m].kept
    assert not any(r.kept for i, r in got.items() if "junk" in (rows[i][0] or "") or rows[i][2] == "dirty")
    salted = {r.doc_id: r.kept for r in quality_rules.judge(d, broadcast_rows=0).collect()}
    assert salted == {i: r.kept for i, r in got.items()}
    assert quality_rules.filter_documents(d.limit(0)).count() == 0
    nameless = d.withColumn("doc_id", F.when(F.col("doc_id") >= 10, F.col("doc_id")))
    kept = quality_rules.filter_documents(nameless.unionByName(nameless))
    assert kept.columns == d.columns and kept.count() == 2 * sum(r.kept for r in got.values())


@pytest.mark.parametrize("size", [30, 120, 500])
def test_quality_rules_groups_decide(spark, size):
    """Of two sources of any size, what is usual in one fails in the other."""
    rng = random.Random(size)
    dense = lambda: " ".join(f"v{rng.randrange(900)}" + " #" * rng.randrange(2) for _ in range(100))
    rows = [(i, prose(rng, 100), "en", "prose") for i in range(size)] + [(size + i, dense(), "en", "dense") for i in range(size)]
    rows += [(2 * size + i, prose(rng, 100), "en", "more") for i in range(1, size)] + [(2 * size, dense(), "en", "prose")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(2 * size)) and got[2 * size].failed_symbols


# --- 7


def test_mixing(spark):
    rng = random.Random(7)
    texts = [None, ""] + [prose(rng, rng.randrange(1, 60)) for _ in range(600)]
    d = docs(spark, texts, lambda i: None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}")
    rows = mixing.mix(d).collect()
    sizes = {i: len(tokens((t or "").encode())) for i, t in enumerate(texts)}
    assert all(r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        by[r.source_key] = [by[r.source_key][0] + r.taken, r.source_size, r.target]
    weights = dict(zip([*sorted(k for k in by if k), ""], [3, 1, 2] * 9, strict=False))
    level = {k: t / weights[k] for k, (_, s, t) in by.items() if t < 2 * s - 1e-6}
    assert len({round(x, 6) for x in level.values()}) <= 1
    assert abs(sum(t for _, _, t in by.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(abs(taken - t) <= 30 for taken, _, t in by.values())
    assert all((r.shard_1 is None) == (r.copies < 1) and (r.shard_2 is None) == (r.copies < 2) for r in rows)
    assert {tuple(r) for r in mixing.mix(d).collect()} == {tuple(r) for r in rows}
    copies = mixing.repeated(d)
    assert copies.count() == sum(r.copies for r in rows)
    mixing.write_mix(copies, path := new_path(spark, "mix"))
    assert spark.read.parquet(path).count() == copies.count()
    assert mixing.mix(d.limit(0)).count() == 0
    twice = mixing.mix(d.unionByName(d)).groupBy("doc_id").agg(F.count_distinct("copies").alias("n")).filter("n > 1").count()
    assert twice == 0
    own = mixing.repeated(d.limit(40).withColumns({"shard": F.lit(-1), "copies": F.lit(-2)}), shard="to", position="at")
    assert {"to", "at"} <= set(own.columns) and {(r.shard, r.copies) for r in own.collect()} <= {(-1, -2)}
    long = mixing.mix(spark.createDataFrame([(0, "w " * 300_000, "s"), (1, "a b", "s")], "doc_id bigint, text string, source string"))
    assert {r.size for r in long.collect()} == {300_000, 2}


def test_splitting_tree(spark):
    quotas = {"a": 40, "b": 25, "c": 1, "d": 0, "e": 7}
    q = spark.createDataFrame(list(quotas.items()), "source_key string, quota bigint")
    left = []
    for seed in range(24):
        rows = mixing.splitting_tree(q, 1 if seed else 3, f"t{seed}").collect()
        by = defaultdict(int)
        for r in rows:
            by[r.source_key] += r.quota
        assert dict(by) == {k: v for k, v in quotas.items() if v}
        sizes = Counter()
        for r in rows:
            sizes[r.shard] += r.quota
        assert max(sizes.values()) - min(sizes.values()) <= (1 if seed else 3)
        if seed:
            left.append(sum(r.quota for r in rows if r.source_key == "a" and r.shard == 0))
    # 37 of 73 draws go left, of which 40 are a's: 20.3 on average, with a deviation of 2.1.
    assert abs(np.mean(left) - 37 * 40 / 73) < 4 * 2.1 / 23**0.5 and 0.8 < np.std(left) < 4
    draws = [(k, b, c) for k, n in quotas.items() for b in range(n) for c in (1, 2)]
    got = mixing.dealt(spark.createDataFrame(draws, "source_key string, block int, copy int")).collect()
    assert sorted((r.source_key, r.block, r.copy) for r in got) == sorted(draws)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 3


# --- 8


def test_passages(spark):
    rng = random.Random(8)
    passage = prose(rng, 70)
    w = passage.split()
    fuzzy = " ".join([*w[:20], "changed", *w[21:45], "more", *w[45:]])
    two = prose(rng, 60)
    texts = [
        f"{prose(rng, 40)} {passage} {prose(rng, 40)} {two}", f"{prose(rng, 90)} {passage}", f"{fuzzy} {prose(rng, 10)}", prose(rng, 200), f"{two} {prose(rng, 300)}", None, "", "word " * 3000,
        " ".join(w[:30]) + " " + prose(rng, 50), copy := prose(rng, 120), copy.upper(),
    ]
    got = defaultdict(set)
    for r in passages.find(docs(spark, texts)).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word and r.first_doc <= r.doc_id
    assert set(got) == {0, 1, 2, 4, 9, 10}
    for doc, start, n in ((0, 40, 70), (0, 150, 60), (1, 90, 70), (2, 0, 71), (4, 0, 60), (9, 0, 120), (10, 0, 120)):
        assert set(range(start + 1, start + n - 1)) <= got[doc]
    assert len(got[0]) <= 136 and len(got[1]) <= 76
    cut = {r.doc_id: r.text for r in passages.cut_repeats(docs(spark, texts)).collect()}
    assert cut[0] == texts[0] and cut[3] == texts[3] and passage not in cut[1] and cut[5] is None
    assert passages.find(docs(spark, [])).count() == 0


def test_passages_whose_seeds_lead_to_pieces(spark):
    rng = random.Random(81)
    w = prose(rng, 60).split()
    a1, a2 = (f"{prose(rng, 40)} {' '.join(p)} {prose(rng, 40)}" for p in (w[:34], w[26:]))
    b, c = (f"{prose(rng, n)} {' '.join(w)} {prose(rng, n)}" for n in (20, 35))
    got = {r.doc_id: r for r in passages.find(docs(spark, [a1, a2, b, c])).collect()}
    assert set(got) == {2, 3}
    for doc, start in ((2, 20), (3, 35)):
        assert got[doc].first_doc == 2 and got[doc].start_word <= start and got[doc].end_word >= start + 60 and got[doc].n_words <= 64
    cut = {r.doc_id: r.text for r in passages.cut_repeats(docs(spark, [a1, a2, b, c])).collect()}
    assert cut[0] == a1 and cut[1] == a2 and cut[2] == b and " ".join(w[5:55]) not in cut[3]


def test_passages_of_one_anchor(spark):
    rng = random.Random(82)
    w = prose(rng, 60, 5000).split()
    # Of the runs of words between the edits, the middle one alone is long enough for a seed.
    edited = [f"x{i}" if i in (6, 13, 20, 41, 48, 55) else v for i, v in enumerate(w)]
    texts = [f"{prose(rng, 30, 5000)} {' '.join(v)} {prose(rng, 30, 5000)}" for v in (w, edited)]
    h = [passages.seeds(passages.word_hashes(t.encode())) for t in texts]
    assert len(np.intersect1d(h[0][0], h[1][0])) == 1
    got = {r.doc_id: r for r in passages.find(docs(spark, texts)).collect()}
    assert set(got) == {0, 1} and all(r.start_word <= 31 and r.end_word >= 89 for r in got.values())


def test_passages_every_exact_run(spark):
    rng = random.Random(83)
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(1, 5)):
            old = rng.choice(texts).split() if texts and rng.random() < 0.8 else ["again"] * rng.randrange(80)
            at = rng.randrange(max(1, len(old) - 20))
            t += old[at : at + rng.randrange(20, 70)] + prose(rng, rng.randrange(30)).split()
        texts.append(" ".join(t))
    held = defaultdict(set)
    for i, t in enumerate(texts):
        for a in range(len(t.split()) - 49):
            held[tuple(t.split()[a : a + 50])].add((i, a))
    want = {(i, p) for at in held.values() if len({i for i, _ in at}) > 1 for i, a in at for p in range(a, a + 50)}
    got = {(r.doc_id, p) for r in passages.find(docs(spark, texts)).collect() for p in range(r.start_word, r.end_word)}
    assert want and want <= got


def test_chains_with_gap_costs():
    assert passages.chains([0, 10, 20], [5, 15, 25]) == [[0, 1, 2]]
    assert sorted(map(sorted, passages.chains([0, 10, 500, 510], [0, 10, 500, 510]))) == [[0, 1], [2, 3]]
    assert passages.chains([0, 10], [10, 0]) == []
    rng = random.Random(9)
    here, there = [rng.randrange(60) for _ in range(30)], [rng.randrange(60) for _ in range(30)]
    best = [8.0] * 30
    for i in sorted(range(30), key=lambda i: here[i]):
        for j in range(30):
            if here[j] < here[i] and there[j] < there[i]:
                best[i] = max(best[i], 8 + best[j] - 0.1 * (here[i] - here[j] + there[i] - there[j]))
    chain = passages.chains(here, there)[0]
    score = 8 * len(chain) - 0.1 * sum(here[b] - here[a] + there[b] - there[a] for a, b in zip(chain, chain[1:], strict=False))
    assert abs(score - max(best)) < 1e-9


# --- 9


def test_token_shards(spark):
    for n in (1, 2, 3, 17, 1000):
        x = token_shards.permute(np.arange(n), n, 42)
        assert sorted(x) == list(range(n)) and (token_shards.permute(x, n, 42, backwards=True) == np.arange(n)).all()
    rng = random.Random(10)
    texts = [None, "", "héllo wörld", prose(rng, 60_000), "x" * 20_000] + [prose(rng, rng.randrange(1, 400)) for _ in range(60)]
    texts += texts[5:8]
    path = new_path(spark, "tokens")
    d = docs(spark, texts).repartition(3)
    layout, manifest = token_shards.materialise(d, path, length=64, records=50)
    rows = {r.slot: r for r in manifest.collect()}
    back = {r.slot: np.frombuffer(r.ids, "<u2") for r in token_shards.read_shards(spark, path, layout).collect()}
    assert set(rows) == set(back) == set(range(layout.sequences))
    assert all(zlib.crc32(back[s].tobytes()) == r.crc and r.shard == s // 50 for s, r in rows.items())
    order = sorted(rows, key=lambda s: rows[s].sequence)
    assert (token_shards.permute(np.arange(layout.sequences), layout.sequences, layout.key) == order).all()
    ids = np.concatenate([back[s] for s in order])
    with open(token_shards.RANKS, "rb") as f:
        encoding = token_shards._encoding(f.read())
    parts, at = [], 0
    for e in np.flatnonzero(ids == token_shards.END):
        parts.append(encoding.decode(ids[at:e].tolist()))
        at = e + 1
    assert Counter(p for p in parts if p) == Counter(t for t in texts if t)
    later = token_shards.read_shards(spark, path, layout, first_slot=70).collect()
    assert sorted(r.slot for r in later) == list(range(70, layout.sequences))
    assert all(r.crc == r.read_crc for r in token_shards.verified(d, length=64, records=50).collect())
    assert token_shards.verified(d.limit(0)).count() == 0
    clash = d.withColumns({c: F.lit(1) for c in ("slot", "shard", "ids", "docs", "part")})
    assert token_shards.verified(clash, length=64, records=50).count() == layout.sequences
    named = d.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id for r in token_shards.verified(named, length=64, records=50).collect()} <= {f"d{i}" for i in range(len(texts))}


def test_token_shards_owners(spark, monkeypatch):
    """The first text of each sequence and how many it touches, against a walk through all ids; small runs and flushes."""
    monkeypatch.setattr(token_shards, "RUN", 3)
    rng = random.Random(11)
    texts = [prose(rng, rng.choice((0, 1, 5, 30, 400))) for _ in range(80)]
    with open(token_shards.RANKS, "rb") as f:
        encoding = token_shards._encoding(f.read())
    owner = [i for i, t in enumerate(texts) for _ in range(len(encoding.encode_ordinary(t)) + 1)]
    layout, manifest = token_shards.materialise(docs(spark, texts).coalesce(1), new_path(spark, "tokens"), length=16, records=7)
    rows = sorted(manifest.collect(), key=lambda r: r.sequence)
    assert layout.sequences == len(rows) == -(-len(owner) // 16)
    assert [(r.doc_id, r.docs) for r in rows] == [(o[0], o[-1] - o[0] + 1) for o in (owner[i : i + 16] for i in range(0, len(owner), 16))]


# --- 10


def test_warc(spark):
    same = "<p>" + "same " * 40
    html = [same, None, "", "short", "short", same, "é" * 60, same, "é" * 60, "<p>\r\n\r\n" + "x" * 200]
    rows = [(i * 3 % 10, [None, " ", "http://a b/c\nd", "http://x/"][i % 4], h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.convert(pages).collect()}
    assert len(got) == 10
    for page, _, h in rows:
        raw = (h or "").encode()
        first = min(p for p, _, x in rows if (x or "").encode() == raw)
        revisit = len(raw) >= 100 and first != page
        assert tuple(got[page]) == (page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)
    odd = spark.createDataFrame([(None, None, "a" * 100), (1, None, "a" * 100), (1, "u", "a" * 100)], "page_id bigint, url string, html string")
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in warc.convert(odd).collect()) == {(None, "revisit", 1): 1, (1, "response", None): 2}
    named = spark.createDataFrame([("null", None, "a" * 100, 1), ("a>b\r\nc é", None, "a" * 100, 2), (None, None, "b", 3)], "page_id string, url string, html string, digest int")
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in warc.convert(named).collect()) == {("null", "revisit", "a>b\r\nc é"): 1, ("a>b\r\nc é", "response", None): 1, (None, "response", None): 1}
    long = spark.createDataFrame([(1, "u", "é" * 3_000_000)], "page_id bigint, url string, html string")
    assert warc.convert(long).first().payload_bytes == 6_000_000
    assert warc.convert(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_warc_from_arc(spark, version):
    """A container with pages of other hands: dns and ftp records, dates and addresses of the lines, equal payloads."""
    page = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"x" * 120
    blocks = [("dns:example.org", "19990102030405", "text/dns", b"19990102030405\nexample.org. 60 IN A 10.0.0.1\n"), ("http://example.org/", "19990102030406", "text/html", page), ("ftp://example.org/a", "1999", "application/octet-stream", b"\0\1\r\n\r\n\2"), ("http://example.org/b c", "20000102030406", "text/html", page)]
    raw = warc.arc_start("old.arc", version, "19990101000000")
    for url, date, kind, block in blocks:
        raw += warc.arc_record(version, url, date, block, "old.arc", len(raw), "10.0.0.1", kind)
    records = warc.parse_arc(spark.createDataFrame([(raw,)], "content binary"))
    assert {r.arc for r in records.collect()} == {f"old.arc version {version}"}
    path = new_path(spark, "warc")
    files = warc.write_warc(records, spark.createDataFrame([], "digest string, first string"), path)
    (file,) = [r.file for r in files.collect()]
    with open(file, "rb") as f:
        members = list(warc.gzip_members([f.read()]))
    fields = [dict(line.split(": ", 1) for line in m.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for m in members]
    assert fields[0]["WARC-Type"] == "warcinfo" and b"old.arc" in members[0]
    by = {f["WARC-Target-URI"]: f for f in fields[1:]}
    assert {u: (f["WARC-Type"], f["Content-Type"]) for u, f in by.items()} == {
        "dns:example.org": ("resource", "text/dns"), "http://example.org/": ("response", "application/http; msgtype=response"),
        "ftp://example.org/a": ("resource", "application/octet-stream"), "http://example.org/b c": ("response", "application/http; msgtype=response"),
    }
    assert by["dns:example.org"]["WARC-Date"] == "1999-01-02T03:04:05Z" and by["ftp://example.org/a"]["WARC-Date"] == "1999-01-01T00:00:00Z"
    assert all(f["WARC-IP-Address"] == "10.0.0.1" and f["WARC-Warcinfo-ID"] == fields[0]["WARC-Record-ID"] for f in fields[1:])
    assert len({f["WARC-Record-ID"] for f in fields}) == 5
    back = {(r.record_type, r.payload_bytes) for r in warc.read_warc(files, path).collect()}
    assert back == {("resource", len(blocks[0][3])), ("response", 120), ("resource", len(blocks[2][3]))}


def test_arc_lines():
    for version in (1, 2):
        block = warc.http_block("7", b"pay\nload")
        raw = warc.arc_start("f.arc", version, "20240101000000") + warc.arc_record(version, "http://old url/with blanks", "19991231235959", block, "f.arc", 9)
        (r,) = warc.arc_records(raw)
        assert r["URL"] == "http://old url/with blanks" and r["block"] == block and r["Archive-date"] == "19991231235959"
        with pytest.raises(ValueError):
            list(warc.arc_records(raw[:-12]))
    record = warc.warc_record("7", "http://x/", "19991231", block, hashlib.sha256(b"pay\nload").hexdigest(), None)
    assert b"WARC-Date: 1999-12-31T00:00:00Z" in record
    assert warc.read_record(record)[0] == "7"
