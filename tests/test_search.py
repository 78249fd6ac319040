"""Operators on hand-made vectors, properties on the smallest table, and SQL equality."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.distance import l2sqr, l2sqr_block, l2sqr_u8, register_functions
from tessera.functions.nesting import Timer, as_folder, described, kernels, nest_2d, nest_3d, preview, with_units
from tessera.operators import evaluate, exchange, search
from tessera.operators.config import IVFConfig, IVFPQConfig, validated
from tessera.operators.index import IVFIndex, IVFPQIndex
from tessera.operators.exchange import uniform_vectors
from tessera.operators.kmeans import assign, assign_sql, center_table, initial_points, lloyd, training_sample
from tessera.operators.quantizer import Quantizer
from tessera.operators.search import exact_knn
from tessera.operators.store import export_cells, load, save, trim
from tessera.plans import oracle
from tessera.plans import search as plans
from tessera.sources.vecs import read_vecs

SF = "/root/testdata/sf0.001"


def frame(spark, values):
    rows = [(i, [float(x) for x in np.atleast_1d(v)]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def asked(df):
    return df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@pytest.mark.parametrize("dim", [1, 7, 16, 17, 64])
def test_distances_agree(spark, dim):
    rng = np.random.default_rng(dim)
    x, y = rng.standard_normal((2, 5, dim)).astype("f4")
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i int, a array<float>, b array<float>")
    register_functions(spark)
    rows = df.select("i", l2sqr("a", "b").alias("d"), F.expr("l2sqr(a, b)").alias("s")).orderBy("i").collect()
    expected = np.diag(l2sqr_block(x.astype("f8"), y.astype("f8")))
    assert [r["d"] for r in rows] == expected.tolist() == [r["s"] for r in rows]


def test_u8_distance_is_exact(spark):
    df = spark.createDataFrame([([0] * 300, [255] * 300)], "a array<smallint>, b array<smallint>")
    assert df.select(l2sqr_u8("a", "b")).first()[0] == 300 * 255**2


def test_lloyd_last_round_only_assigns(spark):
    v = frame(spark, [0, 1, 10, 11])
    start = np.array([[[0.0], [1.0]]])
    assert lloyd(v, start, 1)[0].ravel().tolist() == [0, 1]
    two = lloyd(v, start, 2)[0]
    assert two.ravel().tolist() == [0, np.float32(22 / 3)]
    three = lloyd(v, start, 3)[0]
    assert three.ravel().tolist() == [0.5, 10.5]
    assert [r["cid"] for r in assign(v, three).orderBy("vec_id").collect()] == [0, 0, 1, 1]


def test_empty_center_stays_and_ties_go_low(spark):
    v = frame(spark, [0, 10, 5])
    centers = lloyd(v, np.array([[[0.0], [0.0], [10.0]]]), 2)[0]
    assert centers.ravel().tolist() == [2.5, 0, 10]
    tied = assign(v, np.array([[0.0], [10.0]])).where("vec_id = 2").first()
    assert tied["cid"] == 0
    assert assign_sql(v, center_table(spark, np.array([[0.0], [10.0]])), l2sqr).where("vec_id = 2").first()["cid"] == 0


def test_initial_points(spark):
    v = frame(spark, [0, 1, 2])
    assert initial_points(v, 2, 1, "zeros").tolist() == [[0], [0]]
    assert initial_points(v, 2, 1, [2, 0]).tolist() == [[0], [2]]
    assert len(initial_points(v, 2, 1)) == 2
    with pytest.raises(ValueError):
        initial_points(v, 2, 1, [7, 0])


def test_draws_with_replacement(spark):
    v = uniform_vectors(spark, 40, 2)
    rows = {tuple(r["embedding"]) for r in v.collect()}
    drawn = [initial_points(v.repartition(n), 60, 2, "draws", seed) for n, seed in ((1, 5), (7, 5), (1, 6))]
    assert np.array_equal(drawn[0], drawn[1]) and not np.array_equal(drawn[0], drawn[2])
    assert all(tuple(p) in rows for p in drawn[0]) and 1 < len({tuple(p) for p in drawn[0]}) < 40
    assert initial_points(v.where("vec_id = 3"), 4, 2, "draws").tolist() == [v.where("vec_id = 3").first()["embedding"]] * 4
    with pytest.raises(ValueError):
        initial_points(v.limit(0), 1, 2, "draws")


def test_validation(spark):
    for bad in (lambda: IVFPQConfig(10, 4, mp=3), lambda: IVFPQConfig(8, 4, mp=4, kp=257), lambda: IVFConfig(0, 1), lambda: Quantizer(8, 2, 300)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        Quantizer(1, 1, 4).fit(frame(spark, [0, 1, 2, 3]))
    with pytest.raises(ValueError):
        Quantizer(2, 1, 2).set_centers(np.zeros((1, 2, 3)))
    for value in (None, [1.0], [1.0, float("nan")], [1.0, None]):
        df = spark.createDataFrame([(0, value)], "vec_id long, embedding array<float>")
        with pytest.raises(Exception, match="expected 2"):
            validated(df, 2).collect()


def test_probes_and_short_results(spark):
    v = frame(spark, [0, 1, 10, 11, 11])
    index = IVFIndex(IVFConfig(1, 2, 3)).train(v, [0, 2]).populate(v)
    q = asked(v.where("vec_id = 4"))
    with pytest.raises(ValueError):
        index.topw(q, 0)
    with pytest.raises(ValueError):
        index.topw(q, 3, clamp=False)
    rows = index.search(q, 10, 1).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(1, 3), (2, 4), (3, 2)]
    assert index.search(q, 10, 7).count() == 5
    twice = index.topw(q, 1).unionByName(index.topw(q, 1))
    assert index.search_cells(twice, 10).count() == 3
    assert index.append(frame(spark, [11]).withColumn("vec_id", F.lit(9).cast("long"))).search(q, 10, 1).count() == 4
    with pytest.raises(ValueError):
        index.book([2])


def test_probing_all_cells_is_exact_and_blocks_agree(spark, monkeypatch):
    v = plans.vectors(spark, SF)
    q = plans.query_set(v)
    index = plans.ivf(v)
    truth = exact_knn(v, q, 64, 10)
    expected = sorted(truth.collect())
    assert sorted(index.search(q, 10, 8).collect()) == expected
    recalls = [evaluate.recall_at_k(index.search(q, 10, w), truth, 10).first()["recall"] for w in (1, 4, 8)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
    monkeypatch.setattr(search, "BROADCAST_BYTES", 1500)
    assert sorted(exact_knn(v, q, 64, 10).collect()) == expected
    assert sorted(index.search(q, 10, 8).collect()) == expected
    assert index.sizes().agg(F.sum("n")).first()[0] == v.count()


def test_codes_stand_for_decoded_vectors(spark):
    v = plans.vectors(spark, SF)
    index = plans.ivfpq(v)
    q = plans.query_set(v).limit(2)
    rows = index.search_all(q, 20).collect()
    codes = {r["vec_id"]: r["code"] for r in index.postings.collect()}
    query = {r["qid"]: np.array(r["q"], "f8") for r in q.collect()}
    for r in rows:
        decoded = index.pq.decode(np.array([codes[r["vec_id"]]]))
        assert abs(l2sqr_block(query[r["qid"]][None], decoded)[0, 0] - r["dist"]) < 1e-9
    book = Quantizer.from_codebook(index.pq.codebook(spark))
    assert np.array_equal(book.centers, index.pq.centers)


@pytest.mark.parametrize("kind,cells", [("ivf", 1), ("ivf", 3), ("ivfpq", 1)])
def test_store_round_trip(spark, tmp_path, kind, cells):
    v = plans.vectors(spark, SF)
    q = plans.query_set(v)
    index = getattr(plans, kind)(v)
    save(index, str(tmp_path / "i"), spark, cells)
    again = load(str(tmp_path / "i"), spark)
    assert sorted(again.search(q, 5, 2).collect()) == sorted(index.search(q, 5, 2).collect())
    if cells == 1:
        plan = again.book([1, 3])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0]
        export_cells(again, str(tmp_path / "x"))
        assert spark.read.parquet(str(tmp_path / "x" / "cells")).count() == v.count()
    assert trim(v, 10).count() == 10


def test_stream(spark, tmp_path):
    from tessera.streaming.search import search_stream

    v = plans.vectors(spark, SF)
    q = plans.query_set(v)
    index = plans.ivf(v)
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    query = search_stream(index, stream, 5, 2, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == index.search(q, 5, 2).count()


def test_helpers(spark):
    df = spark.createDataFrame([(list(range(12)),)], "a array<int>")
    assert df.select(nest_2d("a", 4)).first()[0] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert df.select(nest_3d("a", 2, 3)).first()[0] == [[[0, 1, 2], [3, 4, 5]], [[6, 7, 8], [9, 10, 11]]]
    assert df.select(nest_2d("a", 5)).first()[0] is None
    assert [with_units(n) for n in (999, 1000, 1_999_999, 3_000_000_000)] == ["999", "1k", "1m", "3b"]
    assert as_folder("a") == as_folder("a/") == "a/" and "numpy" in kernels()
    v = frame(spark, [[1.5, 2], [3, 4]])
    assert described(v) == "vec_id: bigint\nembedding: array<float>" and preview(v.orderBy("vec_id"), 1) == "0 (2): 1.5 2"
    t = Timer()
    with pytest.raises(RuntimeError):
        t.stop()
    t.start()
    t.stop()
    assert t.total >= 0


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = con.sql(oracle.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (f[columns].sort_values(columns).reset_index(drop=True) for f in (got, want))
    assert len(got) == len(want) and len(got)
    for c in columns:
        assert (got[c].to_numpy() == want[c].to_numpy()).all(), c


def test_training_queries_use_tables_above_the_sample(spark):
    from tessera.operators.index import IVFIndex
    from tessera.plans import search

    n = 130_000
    v = spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda d: F.sin(F.col("id") * d).cast("float")).alias("embedding"))
    x = np.array(v.orderBy("vec_id").toArrow()["embedding"].combine_chunks().flatten()).reshape(n, 64).astype("f8")
    own = ((x[:, None] - x[None, : search.KC]) ** 2).sum(axis=2).argmin(axis=1)
    want = np.stack([x[own == c].mean(axis=0) for c in range(search.KC)])
    assert np.allclose(search.ivf(v, 2).coarse, want, atol=1e-6)
    config = search.IVFConfig(search.DIM, search.KC, 1)
    assert np.allclose(IVFIndex(config).train(v, list(range(search.KC))).coarse, x[: search.KC])


BAD = ([1.0, None], [1.0, float("nan")], [1.0], None)


@pytest.mark.parametrize("bad", BAD)
def test_nulls_and_ragged_vectors_are_errors_everywhere(spark, bad):
    good = frame(spark, [[0, 0], [5, 5], [9, 9], [3, 1]])
    df = good.unionByName(spark.createDataFrame([(7, bad)], good.schema))
    centers = np.array([[0.0, 0.0], [9.0, 9.0]])
    quantizer = Quantizer(2, 1, 2).set_centers(centers[None])
    trials = (
        lambda: exact_knn(df, asked(good), 2, 1).collect(),
        lambda: exact_knn(good, asked(df), 2, 1).collect(),
        lambda: assign(df, centers).collect(),
        lambda: lloyd(df, centers[None], 2),
        lambda: Quantizer(2, 1, 2).fit(df, 2, [0, 1]),
        lambda: quantizer.encode(df).collect(),
        lambda: search.coarse_topw(asked(df), centers, 1).collect(),
    )
    for trial in trials:
        with pytest.raises(Exception, match="expected 2|inhomogeneous|numbers"):
            trial()


def test_ids_stay_with_their_vectors(spark):
    v = spark.createDataFrame([(0, [0.0]), (2, [5.0]), (3, [9.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["dist"]) for r in exact_knn(v, asked(v.where("vec_id = 3")), 1, 2).orderBy("rank").collect()] == [(3, 0.0), (2, 16.0)]


def test_many_queries_hold_bounded_distances(spark, monkeypatch):
    held = []

    def counted(x, y):
        held.append(len(x) * len(y))
        return l2sqr_block(x, y)

    rng = np.random.default_rng(2)
    x, q = rng.random((50, 2)), rng.random((100_000, 2))
    monkeypatch.setattr(search, "l2sqr_block", counted)
    found = [np.concatenate(c) for c in zip(*search._nearest_of_block(x, np.arange(50), np.arange(len(q)), q, 1))]
    assert max(held) <= search.TILE and sum(held) == 50 * 100_000 and len(held) > 1
    assert (found[1][:500] == l2sqr_block(x, q[:500]).argmin(axis=0)).all()


def test_search_reads_only_the_partitions_of_its_cells(spark, tmp_path):
    n = 1500
    v = uniform_vectors(spark, 4000, 2)
    index = IVFIndex(IVFConfig(2, n, 1))
    index.coarse = np.random.default_rng(1).random((n, 2))
    index.populate(v, str(tmp_path / "p"))
    assert index.per_part == 2
    q = asked(v.where("vec_id < 3"))
    cells = [r["cid"] for r in index.topw(q, 1100).collect()]
    plan = search.of_cells(index.postings, sorted(set(cells)), index.per_part)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1]
    assert filters.startswith(("part", "isnotnull(part", "cast(part"))or "part#" in filters[:60]
    want = {(r["qid"], r["rank"], r["vec_id"]) for r in exact_knn(v, q, 2, 5).collect()}
    assert {(r["qid"], r["rank"], r["vec_id"]) for r in index.search(q, 5, n).collect()} == want
    before = index.postings.inputFiles()
    index.search(q, 5, 10).collect()
    assert index.postings.inputFiles() == before  # assigned once


def test_training_sample_keeps_its_partitions(spark, monkeypatch):
    v = uniform_vectors(spark, 250_000, 1).repartition(6)
    sample = training_sample(v, 10, 3)
    assert sample.rdd.getNumPartitions() == 6 and 100_000 <= sample.count() < 104_000
    few = uniform_vectors(spark, 50, 1)
    assert training_sample(few, 10, 3).count() == 50


def test_exchange_files(spark, tmp_path):
    v = plans.vectors(spark, SF)
    index = plans.ivfpq(v)
    at = f"file://{tmp_path}/x"
    exchange.write_codebooks(index, at, spark)
    again = exchange.read_codebooks(IVFPQIndex(index.config), at, spark)
    assert np.array_equal(again.coarse, index.coarse) and np.array_equal(again.pq.centers, index.pq.centers)
    with pytest.raises(ValueError):
        exchange.read_codebook(spark, f"{at}/cq_", 1, 3, 64)
    exchange.write_cells(index, at, spark)
    book = [0, 2, 2, 5]
    exchange.load_book(again, at, book, spark)
    want = {(r["cid"], r["vec_id"], tuple(r["code"])) for r in index.book(book).collect()}
    assert {(r["cid"], r["vec_id"], tuple(r["code"])) for r in again.book(book).collect()} == want and want
    q = plans.query_set(v)
    topw = q.select("qid", "q", F.explode(F.array(*(F.lit(c) for c in (0, 2, 5)))).alias("cid"))
    assert sorted(again.search_cells(topw, 4).collect()) == sorted(index.search_cells(topw, 4).collect())
    sizes = read_vecs(spark, f"{at}/posting_lists_lens.ivecs").first()["embedding"]
    assert sizes == [r["n"] for r in index.sizes().orderBy("cid").collect()]
    with pytest.raises(ValueError):
        exchange.load_book(again, at, [99], spark)
    with pytest.raises(Exception, match="exists"):
        exchange.write_codebooks(index, at, spark)


def test_ground_truth_and_trimmed_files(spark, tmp_path):
    v = frame(spark, [0, 4, 9, 9])
    at = str(tmp_path)
    exchange.write_ground_truth(exact_knn(v, asked(v.where("vec_id in (0, 3)")), 1, 2), at)
    assert [r["embedding"] for r in read_vecs(spark, f"{at}/train_groundtruth.ivecs").orderBy("vec_id").collect()] == [[0, 1], [2, 3]]
    assert [r["embedding"] for r in read_vecs(spark, f"{at}/train_distance.fvecs").orderBy("vec_id").collect()] == [[0, 16], [0, 0]]
    exchange.write_trimmed(v, 4, f"{at}/base.bvecs")
    with pytest.raises(ValueError, match="source"):
        exchange.write_trimmed(v, 2, f"file://{at}/base.bvecs", f"{at}/base.bvecs", overwrite=True)
    exchange.write_trimmed(read_vecs(spark, f"{at}/base.bvecs"), 2, f"{at}/small.bvecs", f"{at}/base.bvecs")
    assert [r["embedding"] for r in read_vecs(spark, f"{at}/small.bvecs").orderBy("vec_id").collect()] == [[0], [4]]


def test_uniform_vectors(spark):
    x = np.array([r["embedding"] for r in uniform_vectors(spark, 2000, 3).orderBy("vec_id").collect()])
    assert x.min() >= 0 and x.max() < 1 and abs(x.mean() - 0.5) < 0.02 and len({tuple(r) for r in x}) == 2000
    assert [r["embedding"] for r in uniform_vectors(spark, 5, 3).orderBy("vec_id").collect()] == x[:5].tolist()


def test_shared_dir(spark):
    from tessera.operators.shared import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
