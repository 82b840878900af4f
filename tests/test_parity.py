"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import same

from quillmark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, sf, duck, name):
    same(catalogue.QUERIES[name](spark, sf), duck, catalogue.SQL[name])


def test_names_and_schemas(spark, sf):
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert not [n for n in catalogue.QUERIES if n not in catalogue.SQL and n not in ("recursive_split", "ann_lsh_recall")]


def test_approximate_recall(spark, sf):
    assert catalogue.QUERIES["ann_lsh_recall"](spark, sf).first().recall >= 0.9


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
