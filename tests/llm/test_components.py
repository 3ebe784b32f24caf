import os
import random

import pytest

from trackclean.llm import common
from trackclean.llm.components import components
from trackclean.llm.neardup import joined_components


def test_unsettled_components_are_not_returned(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(links, rounds=2)
    assert {r.component for r in components(links).collect()} == {0}


def test_more_links_join_components(spark):
    rng = random.Random(5)
    some = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    more = [(rng.randrange(80), rng.randrange(80)) for _ in range(20)]
    table = lambda links: spark.createDataFrame([x for x in links if x[0] != x[1]], "a long, b long")
    got = joined_components(components(table(some)), table(more))
    want = components(table(some + more))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tables_are_deleted_with_their_owner(spark, tmp_path):
    folder = common.ensure_checkpoint_dir(spark).removeprefix("file:")
    there = lambda: {x for x in os.listdir(folder) if x.startswith("table-")}
    before = there()
    with common.own_tables(spark):
        kept = common.store(spark.range(3), outer=True)
        with common.own_tables(spark):
            inner = common.store(spark.range(4), outer=True)
            common.store(spark.range(5))
        assert inner.count() == 4 and len(there() - before) == 2
    assert kept.count() == 3 and len(there() - before) == 1
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=1)
    assert len(there() - before) == 1
