"""Exact search: the same hits by every method, at every size, for every kind of identifier."""

import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.operators import agreement, cell_index, sampling, statistics, vector_search

NAN, INF = float("nan"), float("inf")


def cells(queries, items, k, exclude_self=False):
    return cell_index.CellIndex.build(items, cells=5, block_rows=3).search(queries, k, exclude_self)


METHODS = (vector_search.topk_native, vector_search.topk_block, cells)


def hits(found):
    return sorted((str(r["query_id"]), r["rank"], str(r["item_id"]), round(r["score"], 9)) for r in found.collect())


def brute(queries, items, k, exclude_self):
    out = []
    for q, v in queries:
        scored = []
        for i, x in items:
            if exclude_self and str(i) == str(q):
                continue
            norm = np.sqrt(np.dot(v, v) * np.dot(x, x))
            scored.append((round(float(np.dot(v, x) / norm), 12) if norm else 0.0, i))
        scored.sort(key=lambda r: (-r[0], r[1]))
        out += [(str(q), n + 1, str(i), round(s, 9)) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("k", "exclude_self"), [(1, False), (4, True), (100, False)])
def test_hits_of_all_methods(spark, k, exclude_self, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(k))
    vectors = [[float(x) for x in rng.integers(-3, 4, 3)] for _ in range(40)] + [[0.0, 0.0, 0.0], [1.0, 2.0, 2.0], [2.0, 4.0, 4.0]]
    rows = list(enumerate(vectors))
    items = spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(3)
    asked = [r for r in rows if r[0] % 4 == 0]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>").repartition(2)
    def scores(found):  # parallel vectors differ in the last bit, so their order may, too
        return [(q, n, s) for q, n, _, s in found]

    want = scores(brute([(q, np.array(v)) for q, v in asked], [(i, np.array(x)) for i, x in rows], k, exclude_self))
    for method in METHODS:
        found = hits(method(queries, items, k, exclude_self))
        assert scores(found) == want and len({(q, i) for q, _, i, _ in found}) == len(found), method
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)  # over the limit of one block
    monkeypatch.setattr(cell_index, "QUERY_BLOCK", 3)
    for method in METHODS:
        found = hits(method(queries, items, k, exclude_self))
        assert scores(found) == want and len({(q, i) for q, _, i, _ in found}) == len(found), method


@pytest.mark.parametrize("block", [4096, 1])
def test_vectors_that_cant_be_compared_and_all_kinds_of_identifiers(spark, monkeypatch, block):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", block)
    vectors = [[1.0, 0.0], [NAN, 1.0], None, [1.0, 1.0], [0.0, INF], [None, 1.0], [0.0, 0.0]]
    day = datetime.date(2024, 1, 1)
    kinds = {
        "long": list(range(7)), "string": [f"é{k}" for k in range(7)], "date": [day + datetime.timedelta(k) for k in range(7)], "double": [k / 2 for k in range(7)],
        "timestamp": [datetime.datetime(2024, 1, 1, k) for k in range(7)], "decimal(9,2)": [__import__("decimal").Decimal(k) for k in range(7)],
    }
    for kind, ids in kinds.items() if block > 1 else [(k, kinds[k]) for k in ("string", "date")]:
        items = spark.createDataFrame(list(zip(ids, vectors)), f"item_id {kind}, vector array<double>")
        queries = items.withColumnRenamed("item_id", "query_id")
        found = [method(queries, items, 2, True) for method in METHODS]
        assert hits(found[0]) == hits(found[1]) == hits(found[2]) and len(hits(found[0])) == 6
        assert {f.schema["query_id"].dataType.simpleString() for f in found} == {kind.replace("long", "bigint")} == {f.schema["item_id"].dataType.simpleString() for f in found}


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "item_id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    for method in METHODS:
        assert method(one, none, 3).count() == 0 and method(one.limit(0), one.withColumnRenamed("query_id", "item_id"), 3).count() == 0


def test_blocks_that_cant_hold_a_hit_are_left_out(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 16))).tolist()
    items = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "item_id long, vector array<double>")
    queries = items.filter("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    index = cell_index.CellIndex.build(items, cells=40, block_rows=50)
    found, read = index.searched(queries, 10, True)
    assert hits(found) == hits(vector_search.topk_block(queries, items, 10, True))
    assert index.items.count() == 4000
    share = read.count() / (queries.count() * len(index.known.blocks))
    assert share < 0.2
    assert read.count() == read.distinct().count()


# --- plans and tests of the same round ------------------------------------------------------------------


def test_exact_signed_rank_distribution(spark):
    assert statistics.signed_rank_two_sided(8, 6) == 0.109375
    for n in range(1, 9):
        sums = [sum(r for r in range(1, n + 1) if m >> (r - 1) & 1) for m in range(2**n)]
        assert statistics.signed_rank_counts(n) == tuple(sums.count(s) for s in range(n * (n + 1) // 2 + 1))

    def p_of(differences):
        rows = [("a", "b", "m", k, float(d), 0.0) for k, d in enumerate(differences)]
        return statistics.wilcoxon(spark.createDataFrame(rows, "a string, b string, metric string, query_id int, x double, y double")).first()

    assert p_of([-1, 2, 3, 4, -5, 6, 7, 8])["p_value"] == 0.109375
    tied, zero, many = p_of([-1, 2, 3, 4, -4, 6, 7, 8]), p_of([0, 2, 3, 4, -5, 6, 7, 8]), p_of([*range(1, 51), 51])
    assert all(r["p_value"] == pytest.approx(statistics.normal_two_sided(r["z"])) for r in (tied, zero, many))
    assert p_of(range(1, 51))["p_value"] == 2 / 2**50
    assert (p_of([3])["statistic"], p_of([3])["p_value"]) == (0.0, 1.0) and p_of([0, 0])["p_value"] == 1.0


def test_differences_that_are_all_the_same(spark):
    rows = [("a", "b", "m", k, 1.0 + s, 1.0) for k in range(4) for s in (0.5,)]
    found = statistics.ttest(spark.createDataFrame(rows, "a string, b string, metric string, query_id int, x double, y double")).first()
    assert found["statistic"] == INF and found["p_value"] == 0.0


def test_strata_send_on_what_they_need(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.element_at(F.array(F.lit("disagree"), F.lit("agree_rel"), F.lit("agree_not")), (F.col("id") % 3 + 1).cast("int")).alias("stratum"))
    plan = sampling.stratified(rows, ["k"], 12, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_overlapping_groups_without_rows_from_python(spark):
    rows = spark.sql("select * from values (1, 0, 'disagree'), (1, 1, 'agree_rel'), (null, 1, 'agree_rel') as t(a, b, stratum)")
    report = agreement.grouped_report(rows, "a", "b", F.col("a") != F.col("b"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Generate" not in plan.split("Expand")[-1]
    got = {r["group_name"]: (r["n"], r["n_agree"], r["n_disagree"]) for r in report.collect()}
    assert got == {"overall": (3, 1, 1), "disagreements": (1, 0, 1), "agreements": (2, 1, 0), "disagree": (1, 0, 1), "agree_rel": (2, 1, 0), "agree_not": (0, 0, 0)}


def test_more_than_a_few_queries_are_matrix_products_with_the_same_bits(spark, monkeypatch):
    numbers = np.random.default_rng(5).normal(size=(60, 24)).tolist()
    items = spark.createDataFrame([(k, numbers[k % 60]) for k in range(180)], "item_id long, vector array<double>")  # each three times
    queries = items.filter("item_id < 80").withColumnRenamed("item_id", "query_id")

    def found():
        rows = vector_search.topk_native(queries, items, 5, True)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        return "NestedLoopJoin" in plan or "CartesianProduct" in plan, sorted(map(tuple, rows.select("query_id", "rank", "item_id", "score").collect()))

    by_products, mine = found()
    monkeypatch.setattr(vector_search, "NATIVE_QUERIES", 1000)
    by_pairs, theirs = found()
    assert not by_products and by_pairs and mine == theirs


def test_embedded_texts_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(vector_search, "EMBEDDED_BYTES", 10)
    monkeypatch.setattr(vector_search, "EMBEDDED_ROWS", 3)
    texts = ["a b", "", "long é text of more bytes", "c d e f", "g h", "", "", "", "i"]
    batch = pa.RecordBatch.from_pydict({"item_id": list(range(len(texts))), "text": texts})
    parts = [part.column("text").to_pylist() for part in vector_search._slices(batch.slice(0))]
    assert parts == [["a b", ""], ["long é text of more bytes"], ["c d e f", "g h", ""], ["", "", "i"]]
    got = [part.column("vector").to_pylist() for part in vector_search._counted(iter([batch]))]
    assert [sum(v) for part in got for v in part] == [2, 0, 6, 4, 2, 0, 0, 0, 1] and list(map(len, got)) == [2, 1, 3, 3]
