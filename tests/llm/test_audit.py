"""Filter audit against documents walked through every order one at a time, and against its SQL."""

import re
from itertools import permutations

import duckdb

from helixlake.llm import audit, queries
from tests.conftest import DATA


def brute(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)}"""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)), strict=True) if bad}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                fails = sum(x in r[0] for r in mine)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(r[0] == {x} for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        total = {x: sum(out[part, o, o.index(x) + 1][1] for o in map("".join, permutations("ABCDE"))) for x in "ABCDE"}
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                out[part, order, step].append(total[x])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_small_tables_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long + " #", "de"), (4, long, None), (5, None, ""), (6, "", "en"), (7, "A B", "en"), (8, "same " * 130, "de"), (9, long + " #", "de")]
    docs += [(None, long, "en"), (None, "", "en"), (-1, long.upper(), "fr"), (11, "x\x0by\x1cz\x85q|", "fr"), (12, (long + " & ") * 30, "fr"), (13, (long + " & ") * 30, "en")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (3, 0, 1), (6, 1, None), (99, 1, 1), (None, 1, 1), (9, 1, 1), (13, 1, 1)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, lang string, mask string, `a.b` string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(audit.audit_filters(df, told)) == brute(docs, [x for x in labels if x[0] is not None])


def test_query_against_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine = queries.op13_filter_audit(spark, DATA)
    r = c.execute(queries.oracle_sql()["op13_filter_audit"])
    names = [x[0] for x in r.description]
    assert names == mine.columns
    assert sorted(map(tuple, mine.collect())) == sorted(r.fetchall())


def test_edges(spark, edge, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = [(r.doc_id, r.text, r.lang) for r in edge.collect()]
    told = [(r.doc_id, r.quality, r.toxic) for r in labels.collect()]
    assert got(audit.audit_filters(edge, labels)) == brute(docs, told)
    assert audit.audit_filters(none, labels).count() == 0
    assert audit.audit_filters(edge, labels.filter("1 = 0")).agg({"good_lost": "sum"}).first()[0] == 0


def test_zeta_transform(spark):
    from pyspark.sql import functions as F

    counts = [(7 * i * i + 3) % 11 for i in range(32)]
    df = spark.createDataFrame([(counts,)], "c array<bigint>")
    assert df.select(audit.subset_sums(F.col("c"), 5)).first()[0] == [sum(counts[m] for m in range(32) if m & ~u == 0) for u in range(32)]


def test_three_filters_of_ones_own(spark):
    rows = [(part, mask, (part + 1) * (mask + 2), mask, 1) for part in range(2) for mask in range(8) if mask != 5]
    out = audit.orders(spark.createDataFrame([(str(p), *r) for p, *r in rows], "part string, mask int, n long, good long, toxic long"), "XYZ")
    for r in out.collect():
        n = {m: c for p, m, c, _, _ in rows if str(p) == r.part}
        before = sum(1 << "XYZ".index(x) for x in r.filter_order[: r.step - 1])
        own = 1 << "XYZ".index(r.filter_order[r.step - 1])
        assert r.removed == sum(c for m, c in n.items() if not m & before and m & own) and r.kept == sum(c for m, c in n.items() if not m & (before | own))
    total = out.filter("step = 1").groupBy("part").agg({"shapley": "sum"}).collect()
    assert all(x[1] == 6 * 2 * sum(c for p, m, c, _, _ in rows if str(p) == x[0] and m) for x in total)
