"""Written cut points and the scopes that delete them."""

import os

import pytest

from traceloom import session


def test_scratch_deletes_what_cut_wrote(spark):
    df = spark.range(5)
    with session.scratch(spark):
        inner = session.cut(df)
        with session.scratch(spark):
            lost, moved = session.cut(df), session.keep(inner.filter("id > 1"))
        assert inner.count() == 5 and moved.count() == 3
        assert not os.path.exists(_folder(lost))
        result = session.keep(moved)
    assert sorted(r.id for r in result.collect()) == [2, 3, 4]
    assert not os.path.exists(_folder(inner)) and not os.path.exists(_folder(moved)) and os.path.exists(_folder(result))


def test_scratch_ends_with_an_error_too(spark):
    with pytest.raises(ValueError), session.scratch(spark):
        made = session.cut(spark.range(3))
        raise ValueError
    assert not os.path.exists(_folder(made))
    outside = session.cut(spark.range(3))
    assert os.path.exists(_folder(outside)) and outside.count() == 3


def _folder(df):
    """The folder that a table written by ``cut`` is read from, whether or not its files are left."""
    paths = df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths()
    return paths.head().toUri().getPath()
