"""Snapshots of the chunk table: what a write touches, what readers see, killed and concurrent writes, compaction."""

import os
import threading

import pytest

from corpusloom.sources import snapshots as S
from corpusloom.sources.tables import scratch


def rows(spark, text, versions, n=2):
    return spark.createDataFrame([(v, i, text) for v in versions for i in range(n)], "version_id string, chunk_index int, text string")


def seen(df):
    return sorted((r.version_id, r.chunk_index, r.text) for r in df.collect())


def want(**versions):
    return sorted((v, i, t) for v, t in versions.items() for i in range(2))


def files(path):
    root = path.removeprefix("file://") + "/data"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_write_touches_its_own_versions_only(spark):
    path = scratch(spark, "t")
    with pytest.raises(ValueError):
        S.read_chunks(spark, path)
    first = S.write_chunks(rows(spark, "old", "abc"), path)
    before = files(path)
    S.write_chunks(rows(spark, "new", "b"), path)
    assert seen(S.read_chunks(spark, path)) == want(a="old", b="new", c="old")
    assert before.items() <= files(path).items()
    assert seen(S.read_chunks(spark, path, first)) == want(a="old", b="old", c="old")
    S.write_chunks(rows(spark, "again", "b"), path)
    S.delete_versions(rows(spark, "", "cz"), path)
    assert seen(S.read_chunks(spark, path)) == want(a="old", b="again")
    S.write_chunks(rows(spark, "back", "c"), path)
    assert seen(S.read_chunks(spark, path)) == want(a="old", b="again", c="back")
    S.write_chunks(rows(spark, "none", ""), path)
    assert seen(S.read_chunks(spark, path)) == want(a="old", b="again", c="back")


def test_a_reader_sees_old_or_new(spark):
    path = scratch(spark, "t")
    S.write_chunks(rows(spark, "old", "ab"), path)
    reader = S.read_chunks(spark, path)
    S.write_chunks(rows(spark, "new", "ab"), path)
    assert S.compact(spark, path, most_dead=0.1)
    assert seen(reader) == want(a="old", b="old")
    assert seen(S.read_chunks(spark, path)) == want(a="new", b="new")


def test_a_killed_write_leaves_the_old(spark, monkeypatch):
    path = scratch(spark, "t")
    S.write_chunks(rows(spark, "old", "ab"), path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(S._Folder, "rename", killed)
        for change in (lambda: S.write_chunks(rows(spark, "new", "ab"), path), lambda: S.delete_versions(rows(spark, "", "a"), path), lambda: S.compact(spark, path, most_dead=-1)):
            with pytest.raises(KeyboardInterrupt):
                change()
    assert seen(S.read_chunks(spark, path)) == want(a="old", b="old")
    assert S.vacuum(spark, path) == []
    assert len(S.vacuum(spark, path, keep_seconds=-5)) == 5
    assert seen(S.read_chunks(spark, path)) == want(a="old", b="old")


def test_writers_at_once(spark):
    path = scratch(spark, "t")
    S.write_chunks(rows(spark, "old", "abcdef"), path)
    threads = [threading.Thread(target=S.write_chunks, args=(rows(spark, f"by {v}", v), path)) for v in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen(S.read_chunks(spark, path)) == want(a="by a", b="by b", c="by c", d="by d", e="old", f="old")


def test_the_log_is_shortened_and_live_chunks_are_compacted(spark):
    path = scratch(spark, "t")
    for i in range(6):
        S.write_chunks(rows(spark, f"text {i}", "ab" if i % 2 else "bc"), path, log_commits=2)
    expected = want(a="text 5", b="text 5", c="text 4")
    assert seen(S.read_chunks(spark, path)) == expected
    folder = S._Folder(spark, path)
    assert len(S._log(folder)[0]) <= 3 and S.dead_share(spark, path) < 0.7
    S.compact(spark, path, most_dead=0)
    assert seen(S.read_chunks(spark, path)) == expected and S.dead_share(spark, path) == 0
    assert not S.compact(spark, path)
    S.vacuum(spark, path, keep_seconds=-5)
    assert seen(S.read_chunks(spark, path)) == expected and len(folder.listed("data")) == 1


def test_another_writer_wins_over_a_compaction(spark, monkeypatch):
    path = scratch(spark, "t")
    S.write_chunks(rows(spark, "old", "ab"), path)
    S.write_chunks(rows(spark, "new", "a"), path)
    add = S._add

    def overtaken(folder, chunks):
        done = add(folder, chunks)
        monkeypatch.setattr(S, "_add", add)
        S.write_chunks(rows(spark, "newest", "b"), path)
        return done

    monkeypatch.setattr(S, "_add", overtaken)
    assert not S.compact(spark, path, most_dead=0)
    assert seen(S.read_chunks(spark, path)) == want(a="new", b="newest")
