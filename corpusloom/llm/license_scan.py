"""License scans: ordered signature rules over the words of a text.

A text is normalised to lower-cased words between single blanks, so punctuation and line breaks don't matter. The rules of
``license_rules`` are hand-written regular expressions over names, notices and the licenses' own texts, each with a keyword
that its matches hold; one Aho-Corasick automaton finds the keywords, and only their rules run. Of two detections, one that
lies within the words of another of the same or a higher priority is dropped, by a bisection over the intervals kept so
far, so a text of any length takes time in proportion.

Defined cases: a null or empty text has no words and no detection; repeated rows each get their own result; of
detections with equal priority and words the rule that comes first stays; whole texts of any length are scanned; an empty
table gives no rows. The result is one struct column under a name of the caller's, so no name can clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.llm.common import utf8, words
from corpusloom.llm.license_rules import RULES

#: Phrases that always count, with their labels (fixed values).
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Kind of a rule -> (priority, score).
KINDS = {"tag": (6, 1.0), "body": (5, 0.95), "notice": (4, 0.9), "version": (3, 0.8), "name": (2, 0.6), "hint": (1, 0.3)}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    score: float
    keyword: str
    pattern: re.Pattern


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules as they stand."""
    out = []
    for line in RULES.strip().splitlines():
        kind, label, keyword, pattern = line.split(" ", 3)
        pattern = re.sub(r"<(\d+)>", r"(?:[^ ]+ ){0,\1}?", pattern)
        out.append(Rule(label, kind, *KINDS[kind], f" {keyword.replace('_', ' ')} ", re.compile(f"(?<= )(?:{pattern})(?= )".encode())))
    return tuple(out)


@lru_cache(maxsize=1)
def _keywords():
    machine = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        by.setdefault(rule.keyword, []).append(i)
    for key, at in by.items():
        machine.add_word(key, at)
    machine.make_automaton()
    return machine


def suppressed(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of detections (priority, rule, start, end), those within none of the same or a higher priority, in order of words."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    reach: list[int] = []  # the furthest end of an interval kept that starts at starts[i] or before
    for _, level in groupby(sorted(found, key=lambda x: (-x[0], x[2], -x[3], x[1])), key=lambda x: x[0]):
        before, furthest = (starts, reach), -1
        for one in level:
            at = bisect_right(before[0], one[2]) - 1
            if one[3] > max(furthest, before[1][at] if at >= 0 else -1):
                kept.append(one)
                furthest = one[3]
        starts, reach, furthest = [], [], -1
        for one in sorted(kept, key=lambda x: x[2]):
            furthest = max(furthest, one[3])
            starts.append(one[2])
            reach.append(furthest)
    return sorted(kept, key=lambda x: (x[2], x[3], x[1]))


def blanks(text: bytes) -> np.ndarray:
    """Where the blanks of a normalised text are: word i follows blank i."""
    return np.flatnonzero(np.frombuffer(text, np.uint8) == 32)


def detections(text: bytes, gated: bool = True) -> list[tuple[int, int, int]]:
    """(rule, first word, word after the last) of a normalised text, in order of words; contained ones are suppressed."""
    run = range(len(rules())) if not gated else sorted({i for _, at in _keywords().iter(text.decode("latin-1")) for i in at})
    met = [(i, *m.span()) for i in run for m in rules()[i].pattern.finditer(text)]
    if not met:
        return []
    edge = blanks(text)
    start, end = np.searchsorted(edge, [m[1] for m in met]), np.searchsorted(edge, [m[2] for m in met])
    found = [(rules()[m[0]].priority, m[0], int(a) - 1, int(b)) for m, a, b in zip(met, start, end, strict=True)]
    return [(i, a, b) for _, i, a, b in suppressed(found)]


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(first word, label) of each place where the words of a base phrase stand consecutively."""
    out = []
    for phrase, label in BASE:
        key, at = f" {phrase} ".encode(), -1
        while (at := text.find(key, at + 1)) >= 0:
            out.append((at, label))
    if not out:
        return out
    word = np.searchsorted(blanks(text), [at for at, _ in out])
    return sorted((int(w), label) for w, (_, label) in zip(word, out, strict=True))


def scan_text(raw: bytes | None) -> dict:
    w = words(raw)
    text = b" " + b" ".join(w) + b" "
    found = [(rules()[i], a, b) for i, a, b in detections(text)]
    return {
        "n_words": len(w),
        "base": [{"word": i, "label": label} for i, label in base_places(text)],
        "found": [{"label": r.label, "way": r.kind, "start": a, "end": b, "score": r.score} for r, a, b in found],
    }


RESULT = (
    "struct<n_words:bigint,base:array<struct<word:bigint,label:string>>,"
    "found:array<struct<label:string,way:string,start:bigint,end:bigint,score:double>>>"
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
        ("found", pa.list_(pa.struct([("label", pa.string()), ("way", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
    ]
)


def scan(text: Column) -> Column:
    """n_words, base (places of the base phrases) and found (the rules' detections, with words and scores) of a text."""

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        return pa.array([scan_text(raw) for raw in texts.to_pylist()], _ARROW)

    return scanned(utf8(text))


def digest(r: Column) -> list[Column]:
    """The columns of the report, from scan()'s struct."""
    labels = F.array_sort(F.array_distinct(r["base"]["label"]))
    both = F.array_sort(F.array_union(r["base"]["label"], r["found"]["label"]))
    return [
        r["n_words"].alias("n_words"),
        F.size(r["base"]).cast("bigint").alias("n_base"),
        F.array_min(r["base"]["word"]).alias("first_word"),
        F.array_max(r["base"]["word"]).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce(F.array_max(r["found"]["score"]), F.when(F.size(r["base"]) > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    ]
