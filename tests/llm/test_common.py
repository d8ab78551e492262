import numpy as np

from mvspark.llm.common import ascii_lower, connected_components
from pyspark.sql import functions as F


def test_components_equal_search(spark):
    rng = np.random.default_rng(1)
    edges = rng.integers(-300, 300, (350, 2)).tolist() + [[1000 + k, 1001 + k] for k in range(60)] + [[5000, 5001 + k] for k in range(200)] + [[7, 7]]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        if x in want:
            continue
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_ascii_is_lowered(spark):
    df = spark.createDataFrame([("ABCxyz\u00c0\u0130\u212a",), ("ABC",), (None,)], "t string")
    assert [r[0] for r in df.select(ascii_lower(F.col("t"))).collect()] == ["abcxyz\u00c0\u0130\u212a", "abc", None]
