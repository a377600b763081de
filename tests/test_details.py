"""Offsets of repeated chunks, and documents in pages."""

import random

from corpusloom.operators import chunk, registry


def test_offsets_of_repeated_chunks_ascend(spark):
    rng = random.Random(2)
    docs = [(1, "abab abab cd"), (2, "éa𝄞b " * 50), (3, None), (4, ""), (5, "x" * 100_000)]
    chunks = [(1, i, f"1-{i}", t, "k") for i, t in enumerate(["ab", "ab", "ab", "zz", "ab", "ab", "cd", "", None])]
    chunks += [(2, i, f"2-{i}", "éa𝄞b ", "k") for i in range(50)] + [(3, 0, "3-0", "a", "k"), (4, 0, "4-0", "a", "k"), (9, 0, "9-0", "a", "k")]
    chunks += [(5, i, f"5-{i:03d}", "x" * 1000, "k") for i in range(100)]
    rng.shuffle(chunks)
    c = spark.createDataFrame(chunks, "doc_id int, chunk_index int, chunk_id string, text string, extra string")
    got = {r.chunk_id: (r.start, r.end) for r in chunk.chunk_offsets(c, spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    want = [(0, 2), (2, 4), (5, 7), (0, 0), (7, 9), (0, 0), (10, 12), (0, 0), (0, 0)]
    assert [got[f"1-{i}"] for i in range(9)] == want
    assert [got[f"2-{i}"] for i in range(50)] == [(5 * i, 5 * i + 5) for i in range(50)]
    assert got["3-0"] == got["4-0"] == (0, 0) and "9-0" not in got
    assert [got[f"5-{i:03d}"] for i in range(100)] == [(i, i + 1000) for i in range(100)]


def test_documents_in_pages(spark):
    versions = [("d", f"d{i}", i, "ready") for i in range(30)] + [("e", "e1", 1, "failed")]
    chunks = [(f"d{i}", j, f"h{i}-{j}") for i in range(30) for j in range(i % 4)]
    v = spark.createDataFrame(versions, "document_id string, version_id string, version_number int, status string").repartition(4)
    c = spark.createDataFrame(chunks, "version_id string, chunk_index int, chunk_hash string")
    j = spark.createDataFrame([("d3", 1, 5, "old"), ("d3", 2, 9, "new")], "version_id string, job_id int, start_time int, job_status string")
    rows = registry.document_details(v, c, j, 7).collect()
    heads = {r.document_id: (r.n_versions, r.n_chunks) for r in rows if r.page == 0}
    assert heads == {"d": (30, len(chunks)), "e": (1, 0)}
    pages = sorted((r for r in rows if r.document_id == "d" and r.page), key=lambda r: r.page)
    assert [r.page for r in pages] == list(range(1, len(pages) + 1)) and {len(r.rows) for r in pages[:-1]} == {7} and len(pages[-1].rows) <= 7
    want = [(i, j if i % 4 else None) for i in reversed(range(30)) for j in range(max(1, i % 4))]
    assert [(x.version_number, x.chunk_index) for r in pages for x in r.rows] == want
    assert {x.job_status for r in pages for x in r.rows if x.version_number == 3} == {"new"}
    assert [(r.page, [(x.status, x.chunk_hash) for x in r.rows]) for r in rows if r.document_id == "e" and r.page] == [(1, [("failed", None)])]
