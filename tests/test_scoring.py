from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.functions.text import clean
from duskwatch.operators import evaluation as E
from duskwatch.operators import features, fusion, scores, windows
from duskwatch.operators.neighbours import nearest, top_k
from duskwatch.plans import scoring


def _sequence(spark, count):
    return spark.createDataFrame([(1, i, f"line {i}") for i in range(count)], "seq_id INT, idx BIGINT, line STRING")


@pytest.mark.parametrize("lines, size, expected", [(15, 5, 3), (17, 5, 4)])
def test_fixed_windows(spark, lines, size, expected):
    out = windows.fixed_windows(_sequence(spark, lines), size).orderBy("window_idx").collect()
    assert len(out) == expected
    assert out[0]["text"] == " [SEP] ".join(f"line {i}" for i in range(size))
    assert out[-1]["end_idx"] == lines


@pytest.mark.parametrize("lines, size, stride, expected", [(10, 5, 1, 6), (15, 5, 3, 4), (3, 5, 1, 0)])
def test_sliding_windows(spark, lines, size, stride, expected):
    out = windows.sliding_windows(_sequence(spark, lines), size, stride).collect()
    assert len(out) == expected
    assert all(r["start_idx"] == r["window_idx"] * stride and len(r["logs"]) == size for r in out)


def test_stride_beyond_size_and_single_line(spark):
    assert windows.sliding_windows(_sequence(spark, 20), 3, 7).count() == 3
    assert windows.make_windows(_sequence(spark, 1), "sliding", 5).count() == 1


def test_cleaning(spark):
    text = "2023-10-10 08:02:30.123 INFO DFSClient: Successfully read block BP-xxx"
    out = spark.createDataFrame([(text,)], "t STRING").select(clean("t")).first()[0]
    assert out == "dfsclient successfully read block bpxxx"


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    matrix = np.vstack([rng.normal(size=(300, 8)), np.full((3, 8), 9.0)])
    rows = [(i, row.tolist()) for i, row in enumerate(matrix)]
    return matrix, spark.createDataFrame(rows, "id BIGINT, vec ARRAY<DOUBLE>")


def _bank(df):
    return df.select(F.col("id").alias("bank_id"), "vec")


def test_nearest_matches_brute_force_on_both_routes(points):
    matrix, df = points
    gaps = np.linalg.norm(matrix[:, None] - matrix[None], axis=2)
    for limit in (10_000, 40):
        found = nearest(df, _bank(df), 7, "id", limit=limit).collect()
        for row in found:
            expected = sorted(zip(gaps[row["id"]], range(len(matrix))))[:7]
            assert np.allclose([n["distance"] for n in row["neighbours"]], [d for d, _ in expected], atol=1e-9)


def _clusters(count, dims, seed=2):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(80, dims)) * 8
    matrix = centres[draw.integers(0, 80, count)] + draw.normal(size=(count, dims))
    matrix[: count // 4] = matrix[0]  # a quarter of all rows are copies
    return matrix


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pivots_find_the_same_neighbours_with_few_pairs(spark, metric):
    """20,000 clustered vectors with a large group of copies, each without itself, a column carried along."""
    count, k = 20_000, 4
    matrix = _clusters(count, 6)
    df = spark.createDataFrame([(i, row.tolist(), f"n{i}") for i, row in enumerate(matrix)], "bank_id BIGINT, vec ARRAY<DOUBLE>, name STRING")
    report = {}
    found = nearest(df.drop("name").repartition(8), df, k, "bank_id", metric=metric, skip_self=True, limit=1500, carry=("name",), report=report)
    ids = np.arange(count)
    expected = top_k(matrix, matrix, ids, k, metric, ids)
    rows = found.select("bank_id", "neighbours").collect()
    assert len(rows) == count
    for row in rows:
        assert [n["bank_id"] for n in row["neighbours"]] == [i for _, i in expected[row["bank_id"]]]
        assert [n["name"] for n in row["neighbours"]] == [f"n{i}" for _, i in expected[row["bank_id"]]]
        assert np.allclose([n["distance"] for n in row["neighbours"]], [d for d, _ in expected[row["bank_id"]]], atol=1e-9)
    assert report["pairs"] < count * count / 20


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_vectors_without_clusters_move_a_few_times(spark, shift):
    """Where no cell can be left out, a query is not moved once per cell; far from the origin too, and with equal distances."""
    count, k = 3_000, 6
    matrix = np.random.default_rng(5).normal(size=(count, 24))
    matrix[:200] = np.eye(24)[np.arange(200) % 24] * np.arange(1, 201)[:, None]
    matrix += shift
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "id BIGINT, vec ARRAY<DOUBLE>")
    report = {}
    found = nearest(df, _bank(df), k, "id", skip_self=True, limit=200, report=report).collect()
    assert len(found) == count
    for row in found:
        gaps = np.sqrt(((matrix[row["id"]] - matrix) ** 2).sum(axis=1))
        gaps[row["id"]] = np.inf
        assert [n["bank_id"] for n in row["neighbours"]] == np.lexsort((np.arange(count), gaps))[:k].tolist()
    assert report["visits"] <= 8 * count


def test_pivots_with_few_vectors_and_without_queries(spark):
    """Fewer bank vectors than neighbours asked for, null vectors, an empty query table."""
    rows = [(i, [float(i % 3), 1.0]) for i in range(5)]
    bank = spark.createDataFrame(rows, "bank_id BIGINT, vec ARRAY<DOUBLE>")
    queries = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "id BIGINT, vec ARRAY<DOUBLE>")
    found = {r["id"]: r["neighbours"] for r in nearest(queries, bank, 9, "id", limit=2).collect()}
    assert [n["bank_id"] for n in found[7]] == [0, 3, 1, 4, 2] and found[8] is None
    assert nearest(queries.limit(0), bank, 2, "id", limit=2).count() == 0


def test_one_visit_gives_the_scores_of_each_method(points):
    """Inside and beyond the broadcast limit, against the scores computed one by one."""
    _, df = points
    bank = _bank(df).filter("bank_id < 300")
    fitted = scoring.fit_detector(bank, dims=4)
    single = scores.knn_score(df, bank, "id")
    single = scores.cluster_score(single, fitted.centres)
    single = scores.reconstruction_score(scores.forest_score(single, fitted.forest, fitted.sample), fitted.directions)
    single = {r["id"]: r for r in scores.lof_novelty(single, bank, "id").collect()}
    raw_angle = {r["id"]: r["neighbours"][0]["distance"] for r in nearest(df, bank, 1, "id", metric="cosine").collect()}
    args = (df, fitted.density, fitted.centres, fitted.directions, fitted.forest, fitted.sample)
    for limit in (None, 40):
        for row in scores.all_scores(*args, limit=limit).collect():
            for method in scores.fixed.METHODS:
                assert row[method] == pytest.approx(single[row["id"]][method], abs=1e-9), method
            assert row["contrastive_distance"] == pytest.approx(raw_angle[row["id"]], abs=1e-9)


def test_sliding_windows_cross_blocks(spark):
    """Blocks of 7 lines; windows equal those cut from the whole list."""
    for count, size, stride in ((40, 5, 3), (23, 7, 1), (21, 7, 7), (30, 2, 5)):
        out = windows.sliding_windows(_sequence(spark, count), size, stride, block=7).orderBy("window_idx").collect()
        starts = range(0, count - size + 1, stride)
        assert [r["start_idx"] for r in out] == list(starts)
        assert [r["logs"] for r in out] == [[f"line {i}" for i in range(s, s + size)] for s in starts]


def test_ties_take_the_smaller_id():
    bank = np.zeros((6, 2))
    assert [i for _, i in top_k(np.zeros((1, 2)), bank, np.arange(6), 3, "euclidean", None)[0]] == [0, 1, 2]


def test_factor_matches_brute_force(points):
    matrix, df = points
    k = 10
    gaps = np.linalg.norm(matrix[:, None] - matrix[None], axis=2)
    np.fill_diagonal(gaps, np.inf)
    order = np.argsort(gaps, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(gaps, order, axis=1)
    reach = np.maximum(near[:, -1][order], near)
    density = 1 / (reach.mean(axis=1) + 1e-10)
    expected = density[order].mean(axis=1) / density
    found = {r["id"]: r["lof"] for r in scores.lof(df, "id", k).collect()}
    assert np.allclose([found[i] for i in range(len(matrix))], expected, rtol=1e-6)


def test_detector_ranks_planted_outliers(points):
    matrix, df = points
    bank = features.build_bank(df.filter("id < 300"), "id")
    found = scoring.score(df, scoring.fit_detector(bank, dims=4)).collect()
    for method in ("knn", "cluster", "iforest", "ensemble"):
        top = {r["id"] for r in sorted(found, key=lambda r: -r[method])[:3]}
        assert top == {300, 301, 302}, method
        assert all(0.0 <= r[method] <= 1.0 for r in found)


def test_forest_is_repeatable(points):
    _, df = points
    a, b = (scores.fit_forest(_bank(df), trees=5).collect() for _ in range(2))
    assert a == b


def test_small_banks_score_zero(points):
    _, df = points
    bank = _bank(df).filter("bank_id < 9")
    assert scores.knn_score(df, bank, "id").agg(F.max("knn")).first()[0] == 0.0
    with pytest.raises(ValueError):
        scoring.fit_detector(bank)


def test_constant_scores_are_clipped(spark):
    df = spark.createDataFrame([(1.7,), (1.7,)], "s DOUBLE")
    assert [r["s"] for r in scores.scale_run(df, ["s"]).collect()] == [1.0, 1.0]


def test_variance_weights_of_constant_scores_are_uniform(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 0.1), ("b", 0.1)], "method STRING, score DOUBLE")
    assert [r["weight"] for r in fusion.variance_weights(df).collect()] == [0.5, 0.5]


def test_unknown_method_means_the_ensemble(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4, 0.5)], "knn DOUBLE, cluster DOUBLE, lof DOUBLE, iforest DOUBLE, reconstruction DOUBLE")
    row = fusion.choose_method(fusion.fuse_mean(df), "something").first()
    assert row["score"] == row["ensemble"] == pytest.approx(0.3)
    with pytest.raises(ValueError):
        fusion.fuse(df, "something")


def test_run_summary(spark):
    df = spark.createDataFrame([(s, 0.0, 0.0, s > 0.6) for s in (0.3, 0.8, 0.4)], "score DOUBLE, contrastive_distance DOUBLE, reconstruction_error DOUBLE, is_anomaly BOOLEAN")
    one = scoring.summarize(df).first()
    assert (one["num_windows"], one["max_score"], one["num_anomaly_windows"]) == (3, 0.8, 1)
    assert one["avg_score"] == pytest.approx(0.5)
    empty = scoring.summarize(df.limit(0)).first()
    assert (empty["num_windows"], empty["avg_score"], empty["anomaly_ratio"]) == (0, 0.0, 0.0)


def test_error_lines_score_higher(spark):
    normal = [(1, i, f"user {i % 3} read block {i % 4} ok") for i in range(200)]
    odd = [(2, i, f"user {i % 3} read block {i % 4} ok") for i in range(5)] + [(2, i, "kernel panic segfault fatal exception trap") for i in range(5, 10)]
    schema = "seq_id INT, idx BIGINT, line STRING"
    bank, model = features.bank_from_normal_lines(spark.createDataFrame(normal, schema), 5, 64)
    detector = scoring.fit_detector(bank, model, dims=4)
    found = scoring.detect_sequences(spark.createDataFrame(odd, schema), detector, "fixed", 5).orderBy("window_idx").collect()
    assert len(found) == 2 and found[1]["score"] > found[0]["score"]


def test_augmentation_rules(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(12))) for i in range(60)] + [(99, "a b c")], "id INT, text STRING")
    out = {r["id"]: r for r in features.augment(rows, "id").collect()}
    assert out[99]["augmented"] == "a b c"
    for i in range(60):
        before, after = out[i]["text"].split(), out[i]["augmented"].split()
        assert 12 - 3 <= len(after) <= 12
        if len(after) == 12 and sorted(after) != sorted(before):
            assert 1 <= sum(x != y for x, y in zip(before, after)) <= 2
    again = {r["id"]: r["augmented"] for r in features.augment(rows, "id").collect()}
    assert again == {i: r["augmented"] for i, r in out.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_token_ids_on_both_routes(spark, monkeypatch, broadcast):
    monkeypatch.setattr(features, "BROADCAST_WORDS", 1000 if broadcast else 0)
    rows = spark.createDataFrame([(1, "b a b zz"), (2, None), (3, ""), (4, "a b c d e f")], "id INT, text STRING")
    words = features.build_vocabulary(rows.filter("id = 1"), size=2)
    assert {r["token"]: r["token_id"] for r in words.collect()} == {"b": 1, "a": 2}
    whole = {r["id"]: r["ids"] for r in features.token_ids(rows, words, "id", length=None).collect()}
    assert whole == {1: [1, 2, 1, 3], 2: [], 3: [], 4: [2, 1, 3, 3, 3, 3]}
    short = {r["id"]: r["ids"] for r in features.token_ids(rows, words, "id", length=3).collect()}
    assert short == {1: [1, 2, 1], 2: [0, 0, 0], 3: [0, 0, 0], 4: [2, 1, 3]}


# --- evaluation ----------------------------------------------------------------


def test_class_separation_matches_all_pairs(spark):
    """Three classes, one of a single row; rows without vector or label do not count."""
    draw = np.random.default_rng(4)
    matrix = np.vstack([draw.normal(size=(40, 3)) + 1e6, draw.normal(size=(25, 3)) + 1e6 + 2, [[1e6 + 9.0] * 3]])
    labels = np.array([0] * 40 + [1] * 25 + [7])
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(matrix, labels))] + [(90, None, 0), (91, [0.0] * 3, None)]
    df = spark.createDataFrame(rows, "id BIGINT, vec ARRAY<DOUBLE>, label INT").repartition(3)
    square = ((matrix[:, None] - matrix[None]) ** 2).sum(axis=2)
    values = []
    for i, own in enumerate(labels):
        mine = labels == own
        inner = square[i, mine].sum() / (mine.sum() - 1) if mine.sum() > 1 else None
        outer = min(square[i, labels == k].mean() for k in set(labels) - {own})
        values.append(0.0 if inner is None else (outer - inner) / max(inner, outer))
    one = E.class_separation(df, "id").first()
    assert one["silhouette"] == pytest.approx(np.mean(values), abs=1e-9) and one["inter_distance"] is None
    two = E.class_separation(df.filter("label < 2"), "id").first()
    intra = np.mean([np.sqrt(square[np.ix_(labels == k, labels == k)].mean()) for k in (0, 1)])
    assert two["intra_distance"] == pytest.approx(intra, rel=1e-9)
    assert two["separation_index"] == pytest.approx(two["inter_distance"] / intra)
    assert E.class_separation(df.filter("label = 7"), "id").first()["silhouette"] is None
    assert E.class_separation(df.limit(0), "id").first()["intra_distance"] is None


def test_ties_count_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "score DOUBLE, label INT")
    row = E.areas(E.curve(df)).first()
    assert row["roc_auc"] == pytest.approx(0.875)
    assert row["pr_auc"] == pytest.approx(0.5 * 1.0 + 0.5 * (2 / 3))


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(0.5, 0), (0.2, 0)], "score DOUBLE, label INT")
    row = E.areas(E.curve(df)).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None


def test_areas_of_many_rows_of_both_classes(spark):
    """More pairs of rows of the two classes than an int can hold."""
    df = spark.range(100_000).select((F.col("id") % 10).cast("double").alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    row = E.areas(E.curve(df)).first()
    assert row["roc_auc"] == pytest.approx(0.6) and row["pr_auc"] == pytest.approx(np.mean([i / (2 * i - 1) for i in range(1, 6)]))


def test_first_best_threshold_is_the_lowest(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 0), (0.6, 1)], "score DOUBLE, label INT")
    row = E.best_f1(E.curve(df)).first()
    assert row["threshold"] == 0.6 and row["f1"] == pytest.approx(2 / 3)


def test_stored_report_gives_its_grade(spark):
    df = spark.createDataFrame([(0.925, 3.998, 0.0508, 0.132 / 0.339, -0.98)], "skewness DOUBLE, entropy DOUBLE, anomaly_ratio DOUBLE, cv DOUBLE, lof_score DOUBLE")
    row = E.assess(df, True, False, True).first()
    assert (row["points"], row["grade"]) == (45, "一般")
    assert "异常比例为5.08%，略高，可能需要提高阈值" in row["factors"]
    assert row["suggestions"] == ["考虑提高异常阈值，当前阈值可能过低", "建议尝试其他检测方法或调整特征提取", "建议提供时间戳数据以进行时间趋势分析"]


def test_chronological_split(spark):
    lines = spark.range(200).withColumnRenamed("id", "idx")
    train, held = E.chronological_split(lines, 0.2, 10)
    assert (train.count(), held.count()) == (160, 40)
    assert held.agg(F.min("idx")).first()[0] == 160
    head = E.chronological_split(lines, 0.2, 10, from_head=True)[1]
    assert head.agg(F.max("idx")).first()[0] == 39
    assert E.chronological_split(lines.limit(150), 0.2, 100)[1].count() == 37
    with pytest.raises(ValueError):
        E.chronological_split(lines.limit(0))


def test_short_series(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "idx BIGINT, score DOUBLE")
    assert E.trend(df).first()["trend_slope"] == 0.0
    assert windows.moving_average(df).count() == 0
    assert E.autocorrelation(df).count() == 2


def test_constant_series_has_no_density(spark):
    df = spark.createDataFrame([(0.5,)] * 4, "score DOUBLE")
    assert E.kde_entropy(df).first()["score_entropy"] is None
    assert E.histogram_entropy(df).first()["entropy"] == pytest.approx(0.0, abs=1e-6)
