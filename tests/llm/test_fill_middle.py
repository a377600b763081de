"""Fill-in-middle: round trips, chunks and cuts against plain code points, odd tables."""

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import fill_middle as fm


def brute(key, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_transform(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcéß漢𝄞 \n.") for _ in range(rng.randrange(1, 9)))
    shared = " ".join(word() for _ in range(2000))
    texts = [None, "", "a", "é", "𝄞", "x" * 300_000, "<P>", "a <S> b", "< P>", "<" * 70, "P>", shared * 40]
    texts += ["y" * k + m for k in range(58, 70) for m in ("<P>", "<M>")] + [f"{word()}{shared}{word()}" for _ in range(40)] + [shared[i : i + 700] for i in range(0, 7000, 177)]
    rows = [(None if i == 20 else i, t, "c") for i, t in enumerate(texts)] * 2
    d = spark.createDataFrame(rows, "doc_id bigint, text string, output string").repartition(3)
    out = d.withColumn("r", fm.transform(F.col("doc_id"), F.col("text"))).withColumn("back", fm.restored(F.col("r.form"), F.col("r.output")))
    got = [(r.doc_id, r.text, tuple(r.r), r.back, r.output) for r in out.collect()]
    assert len(got) == len(rows) and {f for *_, r, _, _ in got for f in (r[1],)} == {"plain", "psm", "spm"}
    for key, text, r, back, other in got:
        assert r == brute(key, text) and back == text and other == "c"
    assert out.limit(0).count() == 0 and d.limit(0).select(fm.transform(F.col("doc_id"), F.col("text")).alias("r")).count() == 0
    small = d.withColumn("r", fm.transform(F.col("doc_id"), F.col("text"), cache_bytes=300)).collect()
    assert sorted(map(str, ((r.doc_id, tuple(r.r)) for r in small))) == sorted(map(str, ((k, r) for k, _, r, _, _ in got)))
    every = d.select(fm.transform(F.col("doc_id"), F.col("text"), rate=100, suffix_first=100).alias("r")).groupBy("r.form").count().collect()
    assert {r.form for r in every} == {"plain", "spm"}


def test_shared_passages_share_chunks():
    rng = random.Random(1)
    shared = rng.randbytes(50_000)
    memo = fm.Summaries()
    fm.summary(rng.randbytes(777) + shared, memo)
    before = memo.hits
    ends, _, _ = fm.summary(rng.randbytes(5_001) + shared + b"tail", memo)
    assert memo.hits - before > 0.8 * 50_000 / (2**fm.CHUNK_BITS + fm.LEAST) and ends[-1] == 55_005
    assert max(b - a for a, b in zip(ends, ends[1:], strict=False)) <= fm.MOST


def test_a_hash_that_two_chunks_share_is_verified(monkeypatch):
    monkeypatch.setattr(fm.xxhash, "xxh3_64_intdigest", lambda _: 7)
    memo = fm.Summaries()
    assert [memo.of(x)[0] for x in (b"ab", "é".encode(), b"abc", b"ab")] == [2, 1, 3, 2]


@given(st.text(max_size=400), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_every_cut(text, draws):
    memo = fm.Summaries(200)
    n, form, prefix, middle, output = fm.transform_text(text.encode(), draws, memo)
    assert n == len(text)
    if form != "plain":
        a, b = sorted(h % (n + 1) for h in draws[:2])
        assert (prefix, middle) == (a, b - a)
        p, m, s = text[:a], text[a:b], text[b:]
        assert output.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
