"""The join of fingerprints by cells."""

import random

from sparkstill.llm import simhash
from sparkstill.llm.common import cut


def test_cells_are_joined_by_a_shuffle_however_small_spark_takes_them_to_be(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(50)]
    prints = sorted({*base, *(x ^ (1 << r.randrange(63)) for x in base), *(x ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for x in base)})
    found = simhash.links(cut(spark.createDataFrame([(x,) for x in prints], "fp long"), "prints"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    assert {(x["a"], x["b"]) for x in found.collect()} == want
