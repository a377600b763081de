"""Operators without SQL against plain rewrites that compare everything with everything, or rescan from the start."""

import difflib
import hashlib
import random
import re

import numpy as np

from corpusloom.operators import chunk, embed
from corpusloom.operators import evidence as E
from corpusloom.operators import querylog as Q
from corpusloom.operators import retrieve as R


def test_fuzzy_correct(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9))) for _ in range(120)]
    typos = ["".join(c for c in w if rng.random() > 0.12) or "a" for w in words] + [w[::-1] for w in words[:20]] + words[:10] + ["zz", "q"]
    got = {r.token: r.corrected for r in Q.fuzzy_correct(spark.createDataFrame([(t,) for t in typos], "token string"), spark.createDataFrame([(w,) for w in set(words)], "word string")).collect()}
    want = {}
    for t in set(typos):
        scored = [(difflib.SequenceMatcher(None, w, t, autojunk=False).ratio(), w) for w in set(words)]
        fits = [s for s in scored if s[0] >= (0.85 if len(t) < 5 else 0.75)]
        want[t] = t if t in words or not fits else max(fits)[1]
    assert got == want and sum(a != b for a, b in want.items()) > 40


def test_static_fuzzy_fallback(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["leave", "policy", "travel", "claim", "office", "security", "form"])
    entries = sorted({f"{word()} {word()}" for _ in range(12)})
    asked = [(i, " ".join(w[:-1] if rng.random() < 0.4 else w for w in (word(), word(), word())[: rng.randrange(1, 4)])) for i in range(60)] + [(99, "zzz qqq"), (100, "")]
    hits = spark.createDataFrame([(0, "c"), (5, "c")], "query_id int, chunk_id string")
    got = {r.query_id: (r.entry, r.ratio, r.exact) for r in R.static_fuzzy_fallback(spark.createDataFrame(asked, "query_id int, text string"), hits, spark.createDataFrame([(e,) for e in entries], "entry string")).collect()}
    want = {}
    for i, q in asked:
        ratio, entry = max((round(max(R.partial_ratio(q, e), R.token_set_ratio(q, e)), 4), e) for e in entries)
        if i not in (0, 5) and ratio > 70:
            want[i] = (entry, ratio, ratio > 85)
    assert got == want and len(want) > 30


def test_mmr(spark):
    rng = random.Random(3)
    rows = [(q, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 6))), rng.randrange(5), p) for q in range(12) for p in range(15)]
    got = {}
    for r in E.mmr_select(spark.createDataFrame(rows, "query_id long, sentence string, score int, place int")).orderBy("query_id", "pick").collect():
        got.setdefault(r.query_id, []).append(r.sentence)
    for q in range(12):
        left, out = [(s, n) for i, s, n, _ in rows if i == q], []
        bag = lambda s: set(re.findall(r"\w+", s))
        jaccard = lambda a, b: len(bag(a) & bag(b)) / len(bag(a) | bag(b)) if bag(a) | bag(b) else 0.0
        while left and len(out) < 6:
            value = [0.7 * n - (1 - 0.7) * 10 * max((jaccard(s, o) for o in out), default=0.0) for s, n in left]
            out.append(left.pop(value.index(max(value)))[0])
        assert got[q] == out


def test_embedding(spark):
    texts = ["a b a", "", None, "Éa été 42_x", "word " * 500]
    got = {r.i: r.embedding for r in embed.embed(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2), "text", batch=2).collect()}
    for i, t in enumerate(texts):
        v = np.zeros(embed.DIMENSION)
        for w in re.findall(r"\w+", (t or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % embed.DIMENSION] += 1 if h >> 63 else -1
        size = np.linalg.norm(v)
        assert np.allclose(got[i], v / size if size else v, atol=1e-6)


def test_recursive_chunks(spark):
    """Every piece stands where it says, is no longer than allowed and overlaps the one before by no more than allowed."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "a.", "\n", "\n\n", "x" * 90, "é "]) for _ in range(rng.randrange(0, 400))) for _ in range(30)] + ["", None, "z" * 5000]
    rows = chunk.chunk_recursive(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)).orderBy("doc_id", "chunk_index").collect()
    by = {}
    for r in rows:
        assert texts[r.doc_id][r.start : r.end] == r.text and 0 < len(r.text) <= chunk.SIZE
        assert r.hash == hashlib.sha256(r.text.encode()).hexdigest() and r.n_words == len(r.text.split())
        by.setdefault(r.doc_id, []).append(r)
    for doc, parts in by.items():
        assert [p.chunk_index for p in parts] == list(range(len(parts)))
        assert all(a.start < b.start and a.end - b.start <= chunk.OVERLAP for a, b in zip(parts, parts[1:], strict=False))
        covered = {i for p in parts for i in range(p.start, p.end)}
        assert all(i in covered for i, c in enumerate(texts[doc]) if not c.isspace())
    assert by.keys() == {i for i, t in enumerate(texts) if t and t.strip()}
