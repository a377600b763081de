"""Knowledge entries and aliases met through candidates, against plain comparisons of everything with everything."""

import difflib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import querylog as Q


def plain_knowledge(text, entries, fuzzy):
    """The best entry of one turn, by comparing it with all of them."""
    q = text.strip(" ").lower()
    pieces, w = q.split(" "), list(dict.fromkeys(x for x in q.split(" ") if x))
    alike = lambda a, b, least: difflib.SequenceMatcher(None, b, a, autojunk=False).ratio() >= least
    scored = []
    for place, (name, title, keywords, phrases, threshold) in enumerate(entries):
        shared = len(set(w) & set(keywords))
        holds = any(pieces[i : i + len(p.split(" "))] == p.split(" ") for p in phrases if " " in p for i in range(len(pieces)))
        if q in (title.lower(), name.replace("_", " ").lower(), *phrases):
            s = 1.0
        elif holds:
            s = 0.99
        elif fuzzy:
            near = any(len(x) > 4 and abs(len(x) - len(k)) <= 2 and x[:3] == k[:3] and alike(x, k, 0.8) for x in w for k in keywords)
            one = shared == 1 or shared == 0 and near
            near_phrase = len(q) > 4 and any(set(p.split()) & set(w) and alike(q, p, 0.85) for p in phrases)
            s = 0.9 if near_phrase else 0.95 if shared >= 2 else 0.0 if one and len(w) == 1 and len(keywords) > 1 else 0.82 if one else 0.0
        else:
            part = any(len(x) >= 3 and (x in k or k in x) for x in w for k in keywords)
            s = 0.95 if shared >= 2 else 0.82 if shared == 1 else 0.63 if part else 0.0
        if s and s >= threshold:
            scored.append((-s, place, name))
    scored.sort()
    if not scored or fuzzy and len(scored) > 1 and 0.80 <= -scored[0][0] <= 0.9899 and scored[1][0] - scored[0][0] < 0.15:
        return None
    return scored[0][2], -scored[0][0]


@pytest.mark.parametrize("fuzzy", [False, True])
def test_knowledge_against_all_entries(spark, fuzzy):
    rng = random.Random(fuzzy)
    stems = ["leave", "vacation", "policy", "travel", "office", "secur", "hr", "pay", "é", "contract", "x" * 40, "x" * 35]
    word = lambda: rng.choice(stems) + rng.choice(["", "", "s", "ing", "x"])
    entries = [(f"ENTRY_{i}", f"{word()} {word()}", list(dict.fromkeys(word() for _ in range(rng.randrange(1, 4)))), [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(2)], rng.choice([0.6, 0.7, 0.9])) for i in range(60)]
    texts = [" ".join(word() for _ in range(rng.randrange(1, 6))) for _ in range(150)] + [e[1].upper() for e in entries[:5]] + [f"so {e[3][0]} now" for e in entries[:20]]
    texts += [e[3][0][:-1] for e in entries[:30]] + ["", "  ", "a  b", " leave ", None]
    turns = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id int, turn int, text string").repartition(3)
    got = {r.conv_id: (r.intent_id, r.score) for r in Q.score_knowledge(turns, Q.knowledge_table(spark, entries), ["conv_id", "turn"], fuzzy).collect()}
    want = {i: found for i, t in enumerate(texts) if t is not None and (found := plain_knowledge(t, entries, fuzzy))}
    assert got == want and len(want) > 40


def test_no_product_of_turns_and_entries(spark):
    word = lambda c: F.substring(F.md5(F.col(c).cast("string")), 1, 8)
    entries = spark.range(5_000).select(
        F.col("id").cast("int").alias("place"), F.format_string("E%d", "id").alias("intent_id"), F.format_string("title%d", "id").alias("title"),
        F.array(word("id")).alias("keywords"), F.array(F.format_string("some phrase %d", "id")).alias("phrases"), F.lit(0.7).alias("threshold"),
    )
    turns = spark.range(0, 10_000, 2).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.concat(F.lit("tell me "), word("id"), F.lit(" now")).alias("text"))
    for fuzzy in (False, True):
        scored = Q.score_knowledge(turns, entries, ["conv_id", "turn"], fuzzy)
        assert "CartesianProduct" not in (plan := scored._jdf.queryExecution().toString()) and "BroadcastNestedLoop" not in plan
    assert scored.filter("score >= 0.82").count() >= 2_490


def plain_aliases(text, aliases, protected):
    longest = lambda ps: "|".join(re.escape(p) for p in sorted(ps, key=lambda p: (-len(p.split(" ")), -len(p), p)))
    pattern = re.compile(rf"\b(?:(?P<keep>{longest(protected) or 'x^'})|(?P<alias>{longest(aliases)}))\b", re.I)
    return pattern.sub(lambda m: m[0] if m["keep"] else aliases[m[0].lower()], text)


def test_aliases_against_a_pattern(spark):
    rng = random.Random(6)
    aliases = {"a": "1", "a b": "2", "b c d": "$3", "c": "4", "e-mail": "5", "d a": "6", "é a": "7", "b": r"\8"}
    protected = ("a b c", "hello", "d")
    texts = ["".join(rng.choice(["a", "b", "c", "d", "A", "é", "hello", "e-mail", "e"]) + rng.choice([" ", " ", " ", ", ", "  ", ""]) for _ in range(rng.randrange(1, 15))) for _ in range(300)] + ["", None, "...", "db os"]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "i int, text string, tid int").repartition(3)
    got = {r.i: r.resolved for r in Q.resolve_aliases(d, Q.alias_table(spark, aliases), protected).collect()}
    assert got == {i: t if t is None else plain_aliases(t, aliases, protected) for i, t in enumerate(texts)}
    assert [r.resolved for r in Q.resolve_aliases(d.filter("text = 'db os'")).collect()] == ["database operating_system"]
    assert Q.resolve_aliases(d.limit(0)).count() == 0


def test_many_aliases(spark):
    aliases = spark.range(100_000).select(F.format_string("name%d of", "id").alias("alias"), F.format_string("n%d", "id").alias("replacement"))
    turns = spark.range(2_000).select("id", F.format_string("the name%d of it", F.col("id") * 60).alias("text"))
    began = time.time()
    got = {r.id: r.resolved for r in Q.resolve_aliases(turns, aliases).collect()}
    assert time.time() - began < 90
    assert got == {i: f"the n{i * 60} it" if i * 60 < 100_000 else f"the name{i * 60} of it" for i in range(2_000)}
