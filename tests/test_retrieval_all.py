"""The whole query set against all vectors, block by block."""

import random

from lodestone.operators import score


def test_blocks_give_what_one_list_gives(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)] if i % 9 else [1.0] * 6, i % 3) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    asked = [(i, list(r.embedding)) for i, r in ((r.vec_id, r) for r in df.where("vec_id % 100 = 0").collect())]
    want = sorted(map(tuple, score.nearest(df, asked).collect()))
    for block, side in ((2, 1 << 20), (2, 100), (512, 64 << 20)):
        found = score.nearest_all(df, df.where("vec_id % 100 = 0"), block=block, side=side)
        assert "NestedLoop" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
        got = sorted(map(tuple, found.collect()))
        assert got == want and {r[0] for r in got} == set(range(0, 700, 100))
