"""Queries over all of a table, against brute force."""

from pyspark.sql import functions as F

from rondel import queries


def customers(spark, tmp_path, n):
    spark.range(n).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_two_hop_friends_of_all_customers(spark, tmp_path):
    n = 1100
    got = {r.a: r.n for r in queries.kernel_two_hop_friends_whole(spark, customers(spark, tmp_path, n)).collect()}
    near = {}
    for a in range(n):
        b = (a * 7 + 3) % n
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert max(got) >= 500
    assert got == {a: len((bs | set().union(*(near[b] for b in bs))) - {a}) for a, bs in near.items()}


def test_components_of_all_customers(spark, tmp_path):
    n = 900
    got = {r.node: r.label for r in queries.kernel_components_whole(spark, customers(spark, tmp_path, n)).collect()}
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        x, y = find(a), find((a * 5 + 2) % n)
        root[max(x, y)] = min(x, y)
    assert got == {a: find(a) for a in range(n)}
