"""Queries take all rows of their input."""

from posegrid.plans import catalogue


def test_linked_customers_takes_every_customer(spark, sf_dir):
    got = {r.c_custkey: r.component for r in catalogue.QUERIES["linked_customers"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey", "to_date(o_orderdate) AS day", "o_orderpriority").collect()
    part = {}

    def find(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for r in rows:
        a, b = find(r.o_custkey), find((r.day, r.o_orderpriority))
        if a != b:
            part[a] = b
    least = {}
    customers = {r.o_custkey for r in rows}
    for c in customers:
        least[find(c)] = min(c, least.get(find(c), c))
    assert got == {c: least[find(c)] for c in customers}
