"""Label permutation by blocks of the hash axis gives the p values of the ordered way."""

import pytest
from pyspark.sql import functions as F

from trialgrid.operators import resample as RS


@pytest.mark.parametrize("blocks", [1, 7, 4096])
def test_blocks_change_no_p(spark, blocks):
    n = F.col("id")
    df = spark.range(3000).select(F.when(n % 4 == 0, "a").when(n % 4 < 3, "b").otherwise("none left").alias("k"), n.cast("string").alias("u"),
                                  ((n % 3 == 0) & (n % 4 != 3)).alias("left"), F.when(n % 50 != 1, (n * 7919 % 101) + F.when(n % 3 == 0, 3).otherwise(0)).cast("double").alias("v"))
    run = lambda **a: sorted(map(tuple, RS.label_permutation(df, ["k"], "v", F.col("left"), "u", 40, **a).collect()))
    assert run(blocks=blocks) == run() and len(run()) == 3
    whole = lambda **a: RS.label_permutation(df, [], "v", F.col("left"), "u", 10, **a).collect()
    assert whole(blocks=blocks) == whole()
