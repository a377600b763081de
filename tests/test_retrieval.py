"""Retrieval and evidence on small tables, and their properties."""

import itertools

from pyspark.sql import functions as F

from corpusloom.operators import evidence as E
from corpusloom.operators import registry
from corpusloom.operators import retrieve as R
from corpusloom.plans.retrieval import vectors
from corpusloom.sources.tables import scan_files


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_dense_topk_grows_by_k(spark, data):
    q, c = vectors(spark, data)
    small, large = ({(r.query_id, r.chunk_id, r.rank) for r in R.dense_topk(q, c, k).collect()} for k in (3, 4))
    assert small < large
    one = R.dense_topk(q, c.repartition(8), 3)
    assert small == {(r.query_id, r.chunk_id, r.rank) for r in one.collect()}


def test_rrf_ignores_the_order_of_legs(spark):
    rows = [(1, "metadata", 1, "a", 0.9), (1, "keyword", 1, "b", 0.8), (1, "keyword", 2, "a", 0.7), (1, "vector", 1, "c", 0.6)]
    results = []
    for order in itertools.islice(itertools.permutations(rows), 4):
        got = R.rrf_fuse(table(spark, list(order), "query_id int, leg string, rank int, chunk_id string, score double")).orderBy("rank").collect()
        results.append([(r.chunk_id, r.rrf, r.methods) for r in got])
    assert all(r == results[0] for r in results)
    assert results[0][0] == ("a", round(3 / 61 + 2 / 62, 6), "keyword,metadata")


def test_switched_off_leg_gives_nothing(spark):
    plan = table(spark, [(1, False, True, False)], "query_id int, use_metadata boolean, use_keyword boolean, use_vector boolean")
    hits = table(spark, [(1, 1, "a", 0.5)], "query_id int, rank int, chunk_id string, score double")
    got = R.hybrid_search(plan, {"metadata": hits, "keyword": hits, "vector": hits}).collect()
    assert [(r.chunk_id, r.methods) for r in got] == [("a", "keyword")]


def test_websearch(spark):
    chunks = table(spark, [("a", "red apple pie and tea"), ("b", "apple red pie"), ("c", "red apple coffee milk"), ("d", "red apple only")], "chunk_id string, text string")
    ask = lambda q: {r.chunk_id for r in R.keyword_topk_websearch(table(spark, [(1, q)], "query_id int, text string"), chunks).collect()}
    assert ask('"red apple"') == {"a", "c", "d"}
    assert ask('"red apple" tea or coffee') == {"a", "c"}
    assert ask('"red apple" tea or coffee -milk') == {"a"}
    assert ask("missing") == set()
    assert ask("apple TEA") == {"a", "b", "c", "d"} and ask("TEA") == {"a"} and ask("apple tea") == {"a"} and ask("apple -milk TEA") == {"a", "b", "d"}
    scored = R.keyword_topk_websearch(table(spark, [(1, "apple TEA")], "query_id int, text string"), chunks).collect()
    assert {r.chunk_id: r.score for r in scored} == {"a": 2.0, "b": 1.0, "c": 1.0, "d": 1.0}


def test_fuzzy(spark):
    q = table(spark, [(1, "leave polcy"), (2, "zzz")], "query_id int, text string")
    none = table(spark, [], "query_id int, chunk_id string")
    got = R.static_fuzzy_fallback(q, none, R.dimension(spark, [("leave policy",), ("travel",)], "entry string")).collect()
    assert [(r.query_id, r.entry, r.exact) for r in got] == [(1, "leave policy", True)]


def test_neighbours_and_selection(spark):
    hits = table(spark, [(1, "v-1", "v", 1, 0.9)], "query_id int, chunk_id string, version_id string, chunk_index int, score double")
    chunks = table(spark, [("v", i, f"v-{i}") for i in range(4)], "version_id string, chunk_index int, chunk_id string")
    got = {(r.chunk_id, r.score) for r in R.expand_neighbors(hits, chunks).collect()}
    assert got == {("v-0", 0.0), ("v-1", 0.9), ("v-2", 0.0)}
    scored = table(spark, [(1, f"c{i}", 0.8) for i in range(8)] + [(2, f"c{i}", 0.4) for i in range(8)] + [(3, "c", 0.1)], "query_id int, chunk_id string, evidence_score double")
    tiers = E.confidence_tier(table(spark, [(1,), (2,), (3,), (4,)], "query_id int"), scored)
    assert {r.query_id: r.tier for r in tiers.collect()} == {1: "HIGH", 2: "MEDIUM", 3: "LOW", 4: "LOW"}
    kept = E.adaptive_select(scored, tiers).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in kept} == {1: 2, 2: 4}


def test_mmr_and_compression():
    assert E.mmr(["a b c", "a b c d", "x y z"], [3, 3, 2], 2) == [0, 2]
    out = E.compress(["Alpha beta is good. Page 3. Alpha beta is good.", "| --- |. alpha wins here"], [20, 10], "alpha", "Summary", "high", 5, 100)
    assert [t for _, t, _ in out] == ["Alpha beta is good.", "alpha wins here."]
    assert E.compress(["alpha one two."], [1000], "alpha", "Unknown", "low", 5, 10) == []


def test_registry(spark):
    batch = table(spark, [(1, "f", "x"), (2, "f", "x"), (3, "g", "y")], "arrival int, filename string, checksum string")
    known = table(spark, [("y",)], "checksum string")
    got = {r.arrival: r.duplicate for r in registry.dedupe(batch, known).collect()}
    assert got == {1: False, 2: True, 3: True}
    latest = table(spark, [("f", 4)], "filename string, latest_version int")
    assert {r.arrival: r.version_number for r in registry.assign_versions(batch, latest).collect()} == {1: 5, 2: 6, 3: 1}


def test_scan_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "b.bin").write_bytes(b"no")
    assert [r.text for r in scan_files(spark, str(tmp_path)).collect()] == ["ok  end"]


def test_reasons(spark):
    df = table(spark, [("fine answer",), ("has chunk_id in it",), ("score: 0.9",), ("```x",), ("- a\n- a",), ("",)], "t string")
    got = [r[0] for r in df.select(E.answer_quality(F.col("t"))).collect()]
    assert got == [None, "leak", "score", "fence", "bullets", "empty"]


def test_metadata_search_finds_short_and_inner_words(spark):
    chunks = table(spark, [("a", "notes.txt", "On whales", None), ("b", "x.md", "Seasons", "Ice"), ("c", "x.md", None, None)], "chunk_id string, filename string, heading string, section string")
    asked = table(spark, [(1, "x"), (2, "whales"), (3, "big whales"), (4, "ice"), (5, " "), (6, None), (7, "asons of")], "query_id int, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in R.metadata_search(asked, chunks, 5, match="words").collect()}
    assert got == {(1, "a"): 0.95, (1, "b"): 0.95, (1, "c"): 0.95, (2, "a"): 0.92, (3, "a"): 0.80, (4, "b"): 0.88, (7, "b"): 0.80}


def test_logit_tiers_and_reports(spark):
    hits = table(spark, [(1, 2.5), (2, 0.5), (3, -1.0)], "query_id int, logit double")
    got = E.logit_tier(table(spark, [(i,) for i in (1, 2, 3, 4)], "query_id int"), hits).collect()
    assert {r.query_id: r.tier for r in got} == {1: "HIGH", 2: "MEDIUM", 3: "LOW", 4: "LOW"}
    versions = table(spark, [(1, "text"), (2, ""), (3, "text")], "version_id int, text string")
    report = registry.reindex_report(versions, table(spark, [(1,), (1,)], "version_id int")).collect()
    assert {r.version_id: (r.chunks, r.error) for r in report} == {1: (2, None), 2: (0, "no text"), 3: (0, "no chunks")}


def test_held_passages_against_containment(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("item"), "text")
    docs = docs.unionByName(docs.limit(3).withColumn("item", F.col("item") + 10**6)).unionByName(table(spark, [(-1, None), (-2, "")], "item long, text string"))
    texts = {r.item: r.text or "" for r in docs.collect()}
    needles = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()] + [t[3:43] for t in texts.values()] + [t[-7:] for t in texts.values()] + ["the", None, "", "a b", "é"]
    got = sorted((r.needle, r.item) for r in R.held_passages(table(spark, [(n,) for n in needles], "needle string"), docs).collect())
    want = sorted((n, i) for n in {n for n in needles if n} for i, t in texts.items() if n in t)
    assert got == want and len(got) > 200


def shuffled_rows(spark):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(spark._jvm.java.util.ArrayList(), False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_websearch_meets_few_chunks(spark):
    """A query of frequent words that also asks for a rare one is held against the chunks of that one only."""
    rows = [(f"c{i:04}", "The man of the house " * 20 + ("met Kestrel of the house of the house" if i % 100 == 0 else "")) for i in range(1000)]
    asked = [(i, '"of the" house kestrel') for i in range(50)] + [(90, '"the man of the house" -kestrel'), (91, '"of the house of the" kestrel'), (92, '"house the" kestrel or absent'), (93, '"the absent"')]
    before = shuffled_rows(spark)
    hits = R.keyword_topk_websearch(spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(rows, "chunk_id string, text string"), 5).collect()
    got = {}
    for r in sorted(hits, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    best = [f"c{i:04}" for i in (0, 100, 200, 300, 400)]
    # 22 times "of the", 22 times house, once kestrel; overlapping occurrences count each.
    assert all(got[i] == [(c, 2 * 22 + 22 + 1) for c in best] for i in range(50))
    assert got[90] == [(f"c{i:04}", 5 * 20) for i in range(1, 6)]
    assert got[91] == [(c, 5 + 1) for c in best]
    assert got[92] == [(c, 2 * 19 + 1) for c in best] and 93 not in got
    assert shuffled_rows(spark) - before < 100_000
