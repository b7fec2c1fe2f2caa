import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import match, panorama
from rasterloom.streaming.merge import fold, journal, journal_batch, running_merge, windowed_counts


def test_two_nearest_is_exact(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(size=(30, 8)), r.normal(size=(40, 8))
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, desc array<double>") for x in (a, b)]
    for row in match.two_nearest(*frames).collect():
        d = np.linalg.norm(b - a[row.a_id], axis=1)
        order = np.argsort(d)
        assert row.b_id == order[0] and row.d1 == pytest.approx(d[order[0]]) and row.d2 == pytest.approx(d[order[1]])
    assert match.match_features(*frames, 2.0).count() == 30


@pytest.mark.parametrize("kind", ["clusters", "alike", "few"])
def test_two_nearest_by_cells(spark, kind, monkeypatch):
    """Clusters, many equal descriptors (ties to the smaller id) and hardly any, in many small cells and blocks."""
    monkeypatch.setattr(match, "BLOCK", 16)
    monkeypatch.setattr(match, "CELL", 12)
    r = np.random.default_rng(3)
    a, b = r.normal(size=(60, 6)), r.normal(size=(150, 6)) + 8 * r.integers(0, 3, (150, 1))
    if kind == "alike":
        b[20:120] = b[20]
        a[:5] = b[20]
    if kind == "few":
        b = b[:1]
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, desc array<double>") for x in (a, b)]
    found = {q.a_id: q for q in match.two_nearest(*frames).collect()}
    assert len(found) == len(a)
    for i, v in enumerate(a):
        d = np.sqrt(((b - v) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(b)), d))
        assert found[i].b_id == order[0] and found[i].d1 == pytest.approx(d[order[0]], abs=1e-12)
        assert found[i].d2 is None if len(b) == 1 else found[i].d2 == pytest.approx(d[order[1]], abs=1e-12)
    assert match.two_nearest(frames[0], frames[1].limit(0)).count() == match.two_nearest(frames[0].limit(0), frames[1]).count() == 0


def test_askers_go_to_a_shelf_once(spark, monkeypatch):
    """Descriptors without clusters are near every cell: an asker's row is sent once for all the cells of a shelf, not once a cell."""
    monkeypatch.setattr(match, "BLOCK", 64)
    monkeypatch.setattr(match, "CELL", 4)
    held, kept = [], match.checkpointed
    monkeypatch.setattr(match, "checkpointed", lambda df: held.append(kept(df)) or held[-1])
    r = np.random.default_rng(5)
    a, b = r.normal(size=(50, 16)), r.normal(size=(200, 16))
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, desc array<double>") for x in (a, b)]
    found = {q.a_id: q.b_id for q in match.two_nearest(*frames).collect()}
    assert found == {i: int(np.argmin(np.linalg.norm(b - v, axis=1))) for i, v in enumerate(a)}
    sent = [df.count() for df in held if "block" in df.columns]
    assert len(sent) == 2 and max(sent) <= len(a) * 4


def test_shelves_hold_cells_in_order():
    first, parts, shelves = match.packed(np.array([0, 1000, 1000, 100, 5000, 0, 2048, 1]))
    assert (first.tolist(), parts.tolist(), shelves) == ([0, 0, 0, 1, 2, 4, 5, 6], [1, 1, 1, 1, 3, 1, 1, 1], 7)


def test_groups_of_chains_in_any_order(spark):
    import random

    order = list(range(400))
    random.Random(5).shuffle(order)
    chain = [(order[i], order[i + 1]) for i in range(249)] + [(order[i], order[300]) for i in range(301, 350)] + [(7, 7)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {q.frame: q.grp for q in match.frame_groups(edges, spark.range(400).toDF("frame")).collect()}
    want = {f: min(order[:250]) for f in order[:250]} | {f: min(order[300:350]) for f in order[300:350]}
    assert got == {f: want.get(f, f) for f in range(400)}


def test_overlaps_and_gains(spark):
    points = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (9.0, 1.0)], "px double, py double")
    assert match.features_in_overlap(points, np.array([[1, 0, 3], [0, 1, 0], [0, 0, 1.0]]), 10, 10).first().n == 2
    overlaps = spark.createDataFrame([("p", 0, 1, 100_000, 0.2, 0.4), ("q", 0, 1, 1, 0.0, 0.0)], "pano string, a long, b long, n long, mean_a double, mean_b double")
    gains = {(r.pano, r.frame): r.gain for r in panorama.gains(overlaps).collect()}
    assert gains["p", 0] * 0.2 == pytest.approx(gains["p", 1] * 0.4, rel=0.02) and gains["q", 0] == gains["q", 1] == 1


def test_owner_ties_go_to_the_first(spark):
    w = spark.createDataFrame([(2, 0, 0, 1.0), (1, 0, 0, 1.0), (0, 0, 0, 0.0), (3, 0, 1, 5.0)], "frame_id int, y int, x int, w double")
    assert {(r.x, r.frame_id) for r in match.owners(w).collect()} == {(0, 1), (1, 3)}


def test_fold_takes_back_and_sets_again():
    out = fold([], [], [(1, "click", 1.0), (2, "click", 2.0), (3, "error", 0), (4, "signup", 0), (5, "error", 0), (6, "click", 9.0), (7, "signup", 0), (8, "view", 0)])
    assert [(e, v, d, u) for e, v, d, u in out] == [(1, 1.0, 1, 0), (2, 2.0, 2, 0), (3, 1.0, 1, 1), (4, 2.0, 2, 0), (5, 1.0, 1, 1), (6, 9.0, 2, 0)]


def run_stream(df, mode):
    query = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table("out")


def test_journal_stream_equals_the_table(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    streamed = run_stream(journal(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))), "append")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, journal_batch(events).collect()))


def test_running_merge(spark, tmp_path):
    frames = spark.createDataFrame([(f, 0, x, float(f + x)) for f in range(4) for x in range(3)] + [(9, 0, 0, float("nan"))], "frame_id int, y int, x int, v double")
    frames.write.parquet(str(tmp_path / "f"))
    got = {r.x: (r.v_mean, r.v_max, r.v_n) for r in run_stream(running_merge(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "f"))), "complete").collect()}
    assert got == {0: (1.5, 3.0, 4), 1: (2.5, 4.0, 4), 2: (3.5, 5.0, 4)}


def test_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
