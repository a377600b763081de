"""Cleaning, understanding and chunking on small texts that the corpus doesn't hold."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunk, clean, embed


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_steps(spark):
    assert one(spark, "﻿a​b", T.clean_unicode) == "ab"
    assert one(spark, "‘a’ “b” – c.....", T.normalize_punct) == "'a' \"b\" - c..."
    assert one(spark, "é-\n  té", T.repair_hyphenation) == "été"
    assert one(spark, "one,\ntwo\nThree", T.merge_wrapped_lines) == "one, two\nThree"
    assert one(spark, "a x I b ok", T.drop_ocr_singletons) == "a  I  ok"
    assert one(spark, " a \t b\r\n\n\n\n c ", T.collapse_whitespace) == "a b\n\nc"
    assert one(spark, "x\nPage 12\ny", T.sanitize_extracted) == "x\n\ny"
    assert one(spark, "# T\n[x](y) **A.** B! C? D.", T.clean_markdown_excerpt) == "T (y) A. B! C?"
    assert one(spark, None, T.clean_page) is None


def test_cleaning_is_idempotent(spark):
    dirty = "﻿ a — “b” ....\r\n\n\n c​  d "
    for step in (T.clean_unicode, T.normalize_punct, T.collapse_whitespace):
        once = one(spark, dirty, step)
        assert one(spark, once, step) == once


def test_strip_headers_footers(spark):
    pages = [("d", i, f"HEAD\nbody {i} one\nbody {i} two\nbody {i} three\nFOOT") for i in range(4)] + [("short", i, "HEAD\nx\nFOOT") for i in range(2)]
    got = clean.strip_headers_footers(spark.createDataFrame(pages, "doc string, page int, text string"))
    text = {(r.doc, r.page): r.text for r in got.collect()}
    assert text["d", 1] == "body 1 one\nbody 1 two\nbody 1 three"
    assert text["short", 0] == "HEAD\nx\nFOOT"


def test_understanding(spark):
    df = spark.createDataFrame([("faq.txt", "How to: AWS workflow. Is this an FAQ? Python3 and HTTP2 here")], "f string, t string")
    r = df.select(T.doc_type(F.col("t"), F.col("f")).alias("kind"), T.topics(F.col("t")).alias("topics"), T.tech_entities(F.col("t")).alias("tech"), *T.content_flags(F.col("t"))).first()
    assert (r.kind, r.topics, r.tech) == ("FAQ", ["Cloud"], ["AWS", "FAQ", "Python3", "HTTP2"])
    assert (r.contains_faq, r.contains_workflow, r.contains_architecture) == (True, True, False)
    assert one(spark, "x\n# Title  here\n", lambda t: T.markdown_title(t, F.lit("f"))) == "Title  here"
    assert one(spark, "none", lambda t: T.markdown_title(t, F.lit("f"))) == "f"
    assert one(spark, "nothing", lambda t: T.doc_type(t, F.lit(""))) == "General Document"


def test_recursive_chunks_cover_and_overlap():
    text = "\n\n".join(" ".join(f"word{i}-{j}" for j in range(40 * i)) for i in range(8))
    pieces = chunk.split_recursive(text)
    assert all(len(p) <= chunk.SIZE and text[a : a + len(p)] == p for a, p in pieces)
    covered = set()
    for a, p in pieces:
        covered |= set(range(a, a + len(p)))
    assert covered == set(range(len(text)))
    assert any(b < a + len(p) for (a, p), (b, _) in zip(pieces, pieces[1:], strict=False))
    assert chunk.split_recursive("") == [] and chunk.split_recursive("x" * 2000)[0][1] == "x" * 800


def test_semantic_chunks():
    table = "\n".join("| a | b |" for _ in range(300))
    text = f"# One\n\nSome text here.\n\n## Two\n\n- item\n- item\n\n{table}\n\n```\ncode # not a heading\n```\n" + " ".join(f"s{i}." for i in range(500))
    parts = chunk.split_semantic(text, 100)
    kinds = [p["chunk_type"] for p in parts]
    assert kinds[:4] == ["text", "list", "table", "code_block"] and set(kinds[4:]) == {"text"}
    assert parts[1]["section"] == "One" and parts[1]["subsection"] == "Two"
    assert parts[2]["oversized"] and parts[2]["text"] == table
    assert all(p["n_tokens"] <= 100 for p in parts[4:])


def test_embedding(spark):
    rows = [(1, "a b", None), (2, "", "h")]
    df = spark.createDataFrame(rows, "id int, text string, heading string").select("*", *[F.lit(None).cast("string").alias(c) for c in ("document_type", "topic", "section", "chunk_type")], F.lit("f").alias("filename"))
    got = embed.embed(df.withColumn("input", embed.embedding_input()), "text").orderBy("id").collect()
    assert got[0].input == "Document: f\n\na b" and got[1].input == "Document: f | Heading: h\n\n"
    assert abs(sum(x * x for x in got[0].embedding) - 1) < 1e-6 and not any(got[1].embedding)
