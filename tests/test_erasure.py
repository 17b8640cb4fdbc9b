import pytest

from tracefold.operators import erasure

ROWS = [(1, 1, 7, "a"), (1, 2, None, "b"), (2, 1, 8, "c"), (2, 2, None, "d"), (3, 1, 7, "e"), (None, 1, 7, "f"), (None, 2, None, "g")]


def _rows(spark):
    return spark.createDataFrame(ROWS, "session_id long, turn long, user_id long, content string")


def test_cascade_over_sessions(spark):
    asked = spark.createDataFrame([(7,), (7,), (None,), (99,)], "user_id long")
    got = {(r.session_id, r.turn): (r.content, r.content_deleted, r.deleted_by) for r in erasure.erase_cascade(_rows(spark), asked).collect()}
    gone = lambda by: (None, True, by)
    assert got == {(1, 1): gone("user"), (1, 2): gone("session"), (2, 1): ("c", False, None), (2, 2): ("d", False, None), (3, 1): gone("user"),
                   (None, 1): gone("user"), (None, 2): ("g", False, None)}
    own = erasure.erase_cascade(_rows(spark), asked, cascade=False)
    assert sorted((r.session_id or 0, r.turn) for r in own.filter("content_deleted").collect()) == [(0, 1), (1, 1), (3, 1)]
    events = erasure.erasure_events(own, ["session_id", "turn"], "dpo", "2024-01-01 00:00:00").collect()
    assert len(events) == 3 and {(e.event, e.requester, e.deleted_by) for e in events} == {("DeletionEvent", "dpo", "user")}
    nobody = erasure.erase_cascade(_rows(spark), asked.limit(0))
    assert nobody.filter("content_deleted").isEmpty() and nobody.count() == len(ROWS)


def test_a_crash_before_the_switch_leaves_the_old_version(spark, scratch):
    root = f"{scratch}/content"
    with pytest.raises(FileNotFoundError):
        erasure.read_snapshot(spark, root)
    assert erasure.write_snapshot(_rows(spark), root) == 1 and erasure.read_snapshot(spark, root).count() == len(ROWS)
    asked = spark.createDataFrame([(7,)], "user_id long")
    erased = lambda: erasure.erase_cascade(erasure.read_snapshot(spark, root), asked).select("session_id", "turn", "user_id", "content")

    def crash(number):
        assert number == 2 and erasure.versions(spark, root) == [1, 2]
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        erasure.write_snapshot(erased(), root, before_switch=crash)
    assert erasure.current_version(spark, root) == 1
    assert sorted(r.content for r in erasure.read_snapshot(spark, root).collect()) == list("abcdefg")
    # the next try takes a folder of its own and replaces the version it reads
    assert erasure.write_snapshot(erased(), root) == 3 and erasure.current_version(spark, root) == 3
    assert sorted(r.content for r in erasure.read_snapshot(spark, root).collect() if r.content) == ["c", "d", "g"]
    assert erasure.drop_old(spark, root) == [1, 2] and erasure.versions(spark, root) == [3]
    assert erasure.read_snapshot(spark, root).count() == len(ROWS)
