"""Tables of the shared folder."""

from pathlib import Path

from visloom.storage import discard, noting, written


def test_noted_tables_can_be_discarded(spark):
    before = written(spark.range(3), "note")
    with noting() as outer:
        first = written(spark.range(4), "note")
        with noting() as inner:
            second = written(spark.range(5), "note")
    after = written(spark.range(6), "note")
    assert outer == [first, second] and inner == [second]
    discard(*outer)
    discard(second)  # again: no error
    assert [Path(t.written_to).exists() for t in (before, first, second, after)] == [True, False, False, True]
    assert before.count() == 3 and after.count() == 6
