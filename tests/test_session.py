"""Session helpers: bounded broadcasts, the checkpoint folder."""

import pytest

from draftsmith.session import MAX_BROADCAST_ROWS, broadcast_bounded, checkpoint_dir


def test_broadcast_bound_is_enforced(spark):
    df = spark.range(10)
    assert broadcast_bounded(df, 10, "tiny").count() == 10
    with pytest.raises(ValueError):
        broadcast_bounded(df, MAX_BROADCAST_ROWS + 1, "too big")


def test_checkpoint_dir_is_reused(spark):
    first = checkpoint_dir(spark)
    assert first and checkpoint_dir(spark) == first
    df = spark.range(5).checkpoint(eager=True)
    assert df.count() == 5
