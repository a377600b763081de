"""Conversation repair: audits against a plain search over the grammar's states, pieces against the whole, odd tables."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import turn_repair as tr

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
SPACE = " \t\n\x0b\x0c\r"


def plain_audit(rows):
    """rows: (initial, fault). The cheapest and least audit, by relaxing all states row by row."""

    def inserted(states):
        for _ in range(2):
            for at, (c, a) in list(states.items()):
                for (x, letter), to in NEXT.items():
                    if x == at and letter != "s":
                        states[to] = min(states.get(to, (10**9, "")), (c + 3, a + "I"))
        return states

    states = {"": (0, "")}
    for initial, fault in rows:
        now = {}
        for at, (c, a) in inserted(states).items():
            moves = [(4, "D", at)]
            if fault < 2:
                extra = 3 if fault == 1 else 0
                moves += [(extra, "K", NEXT[at, initial])] if (at, initial) in NEXT else []
                moves += [(3 + extra, "R", to) for (x, letter), to in NEXT.items() if x == at and letter in ("u", "a")]
            for cost, edit, to in moves:
                now[to] = min(now.get(to, (10**9, "")), (c + cost, a + edit))
        states = now
    states = inserted(states)
    return min(states[x] for x in ("", "a") if x in states)


def plain_report(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(v[2].encode()).hexdigest()))
    seen, coded = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        coded.append((role[:1], 2 if not end else 3 if (role, text) in seen else 0 if end[-1] in ".!?" else 1))
        seen.add((role, text))
    cost, audit = plain_audit(coded) if rows else (0, "")
    turns = [t for t, _, _ in rows if t is not None]
    odd, out, at = (len(audit) - audit.count("D")) % 2, [], 0
    for edit in audit:
        role, text = ("user", "assistant")[(len(out) - odd) % 2], ""
        if edit != "I":
            role, text, at = (rows[at][1] if edit == "K" else role), rows[at][2], at + 1
        if edit != "D":
            out.append((edit, role, text))
    n = [sum(f == k for _, f in coded) for k in (2, 3, 1)]
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(coded, coded[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n, illegal, cost, audit, sha), out


def codes(rows):
    return bytes({"s": 0, "u": 1, "a": 2}.get(i, 3) + 4 * f for i, f in rows)


ROWS = st.lists(st.tuples(st.sampled_from("suaax"), st.sampled_from([0, 0, 0, 1, 2, 3])), min_size=1, max_size=14)


@given(ROWS)
def test_alignment(rows):
    cost, audit = tr.align(codes(rows))
    assert (cost, audit.decode()) == plain_audit(rows)


@given(ROWS, st.integers(1, 5))
def test_pieces_fold_to_the_whole(rows, size):
    fold, whole = tr.Fold(), codes(rows)
    for i in range(0, len(whole), size):
        fold.add(tr.transfers(whole[i : i + size]))
    cost, audit = fold.end()
    assert (cost, audit.decode()) == plain_audit(rows)


def test_long_alignment():
    rng = random.Random(5)
    rows = [(rng.choice("uua"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(2000)]
    cost, audit = tr.align(codes(rows))
    assert (cost, audit.decode()) == plain_audit(rows)


def conversations(rng, n):
    out = []
    for c in range(n):
        turns = [(t, "system" if t == 0 and rng.random() < 0.2 else ("user", "assistant")[t % 2], f"word{rng.randrange(5)} {rng.choice(['ok.', 'no', 'why?', ' ', '', 'ends. '])}") for t in range(rng.randrange(1, 12))]
        for _ in range(rng.randrange(3)):
            t, r, x = rng.choice(turns)
            turns.append(rng.choice([(t, r, x), (None, r, x), (t, "user", x), (t, None, x), (t, r, None), (t + 3, "", "late!"), (t, "tool", "x.")]))
        out += [(c, *row) for row in turns]
    return out + [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (77_000, None, None, None), (77_001, None, "user", "x" * 200_000)]


@pytest.mark.parametrize("segment", [tr.SEGMENT, 3])
def test_report(spark, segment):
    rng = random.Random(segment)
    rows = conversations(rng, 40)
    long = [(500, t, rng.choice(["user", "assistant"]), f"{rng.randrange(300)}.") for t in range(700)]
    rows = rows + long
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, k int").repartition(3)
    ids = d.select("conv_id").unionByName(spark.createDataFrame([(88_000,)], "conv_id bigint"))
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(tuple(row))
    want = {c: plain_report(r)[0] for c, r in [*by.items(), (88_000, [])]}
    got = tr.report(d, ids, segment=segment).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    made = {}
    for r in tr.repaired(d, segment=segment).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert made == {c: out for c, r in by.items() if (out := plain_report(r)[1])}


def test_one_conversation_holds_all_rows(spark):
    d = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id") % 5_000, F.lit(".")).alias("text"))
    want = plain_report([(r.turn, r.role, r.text) for r in d.collect()])[0]
    assert [tuple(r)[1:] for r in tr.report(d.repartition(8)).collect()] == [want]
    same = spark.range(5_000).select(F.lit("c").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("t.").alias("text"))
    r = tr.report(same).first()
    assert (r.conv_id, r.duplicate, r.cost, r.audit) == ("c", 4_999, 4 * 4_999 + 3, "K" + "D" * 4_999 + "I")


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate([("system", "be good."), ("user", "a. b?"), ("assistant", "c!"), ("user", None), (None, "d.")])] + [(None, None, "user", "x.")]
    want = []
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        x = "" if hit == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if hit == 2 else x
        want += [(c, t, "user" if hit == 4 else r, x)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    got = [tuple(r) for r in tr.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    d = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert tr.report(tr.damage(d), d).count() == 0 and tr.repaired(d).count() == 0
