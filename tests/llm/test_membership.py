from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumensift.llm import membership
from lumensift.llm.membership import Members


@pytest.mark.parametrize(("bits", "n"), [((16, 27), 3000), ((16, 16), 3000), ((16, 27), 0)])
def test_members(spark, monkeypatch, bits, n):
    """No member is missed; of others few are told to be members, unless the bitmap is too small for so many."""
    monkeypatch.setattr(membership, "BITS", bits)
    values = spark.range(n).select((F.col("id") * 1_000_003 - 10**9).alias("v")).unionAll(spark.sql("select cast(null as bigint)"))
    members = Members(values, "v")
    assert values.where(members.may_have(F.col("v"))).count() == n
    others = spark.range(20_000).select((F.col("id") * 7 + 10**15).alias("v"))
    wrong = others.where(members.may_have(F.col("v"))).count()
    assert wrong <= (2000 if bits[1] == 16 else 2600 if n else 0)
    assert others.where(~members.may_have(F.col("v"))).count() == 20_000 - wrong
