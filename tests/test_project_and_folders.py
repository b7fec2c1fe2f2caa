"""Versions and journals, snapshots of libraries, watched folders, renders that can be ended, views."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from rasterloom.frame import image_rel
from rasterloom.operators import views
from rasterloom.operators.node import EngineError
from rasterloom.plans.graph import Graph, Node, cancel, progress
from rasterloom.plans.project import Project
from rasterloom.sources.library import VERSION, Library, LibraryError, list_subfolders
from rasterloom.streaming.merge import started, watched_folder


def graph():
    g = Graph()
    g.add(Node("src", "image_source"))
    g.add(Node("e", "exposure", {"exposure": 1.0}))
    g.connect("src", "e")
    return g


def test_versions_are_branches_and_journals_recover(spark):
    project, two = Project.empty(spark).save_graph("i", 1, "first", graph()).add_version("i", "second", 1)
    assert two == 2 and project.load_graph("i", 2).to_json() == graph().to_json()
    project = project.log("i", 2, ("do", ["set_param", "e", "exposure", 2.0]), ("do", ["set_param", "e", "exposure", 3.0])).log("i", 2, ("undo",), ("undo",), ("redo",))
    assert project.recover("i", 2).nodes["e"].params["exposure"] == 2.0
    assert project.load_graph("i", 1).nodes["e"].params["exposure"] == 1.0
    assert [tuple(r) for r in project.unsaved().collect()] == [("i", 2, 5)]
    saved = project.save_graph("i", 2, "second", project.recover("i", 2))
    assert saved.unsaved().count() == 0 and saved.load_graph("i", 2).nodes["e"].params["exposure"] == 2.0
    with pytest.raises(EngineError):
        project.load_graph("i", 9)


def small_library(spark):
    images = spark.createDataFrame([("a", "/x/a.jpg", 0), ("b", "/x/b.jpg", 1)], "id string, path string, trashed int")
    thumbs = spark.createDataFrame([("a", "rendered", bytearray(b"12"), 1)], "image_id string, kind string, data binary, updated_at bigint")
    return Library.empty(spark, images=images, thumbnails=thumbs)


def test_snapshots(spark, tmp_path):
    lib, at = small_library(spark), str(tmp_path / "lib")
    assert not lib.save(at, go_on=lambda name: name != "keywords") and Library.is_unfinished(spark, at)
    with pytest.raises(LibraryError):
        Library.pending_upgrade(spark, at)
    assert lib.save(at, thumbnails=False, mode="overwrite") and not Library.is_unfinished(spark, at)
    assert Library.saved_version(spark, at) == VERSION and Library.pending_upgrade(spark, at) is None
    assert Library.counts_unopened(spark, at).first().asDict() == {"images": 2, "folders": 0, "collections": 0}
    Library.snapshot_unopened(spark, at, str(tmp_path / "copy"))
    again = Library.open(spark, str(tmp_path / "copy"))
    assert {r.id for r in again.images.collect()} == {"a", "b"} and again.thumbnails.count() == 0 and again.meta.count() == 0
    older = spark.createDataFrame([("schema_version", "6")], "key string, value string")
    older.write.mode("overwrite").parquet(f"{at}/meta")
    assert Library.pending_upgrade(spark, at) == (6, VERSION)
    with pytest.raises(LibraryError):
        Library.open(spark, at)


def test_batches_are_all_or_nothing(spark):
    lib = small_library(spark)
    both = lib.batch(lambda x: x.set_rating("a", 3), lambda x: x.add_image("c", "/x/c.TIF", None, 9)).checkpoint()
    assert {(r.id, r.rating, r.extension) for r in both.images.collect()} >= {("a", 3, None), ("c", 0, "tif")}
    with pytest.raises(LibraryError):
        lib.batch(lambda x: x.set_rating("a", 3), lambda x: x.add_image("a", "/y.jpg", None, 9))
    assert lib.image("a").first().rating == 0
    moved, was = both.assign_folder_if_elsewhere("c", 4)
    assert was and moved.assign_folder_if_elsewhere("c", 4)[1] is False


def test_restored_collections(spark):
    lib = small_library(spark).create_collection("Best").add_to_collection(1, "a")
    gone, had = lib.delete_collection(1)
    back = gone.restore_collection(1, "Best", None, had)
    assert [(r.id, r.name, r.image_count) for r in back.collection_summaries().collect()] == [(1, "Best", 1)]
    taken = gone.create_collection("Other").restore_collection(1, "Best", "g", had)
    assert {(r.id, r.name) for r in taken.collections.collect()} == {(1, "Other"), (2, "Best")}
    with pytest.raises(LibraryError):
        lib.rename_collection(1, "Best").restore_collection(5, "best", None, had)


def test_watched_folders(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / ".dot").mkdir()
    for name in ("a.jpg", "sub/b.DNG", "notes.txt", ".dot/c.jpg"):
        (folder / name).write_bytes(b"x" * 3)
    seen = []
    run = lambda: started(watched_folder(spark, f"file://{folder}"), lambda df, n: seen.extend(r.path.rpartition("/")[2] for r in df.collect()), str(tmp_path / "ck"), None).awaitTermination()
    run()
    assert sorted(seen) == ["a.jpg", "b.DNG"]  # dotted folders are left out
    (folder / "new.png").write_bytes(b"y")
    run()
    assert sorted(seen) == ["a.jpg", "b.DNG", "new.png"]
    assert [r.path.rpartition("/")[2] for r in list_subfolders(spark, f"file:{folder}").collect()] == ["sub"]


def test_renders_can_be_ended(spark):
    rel = image_rel(spark.range(4000).select(F.lit(0).alias("frame_id"), (F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"), *[F.lit(0.5).alias(c) for c in "rgba"]), 40, 100)
    slow = F.udf(lambda v: time.sleep(0.05) or v, "double")
    failed = []

    def work():
        try:
            graph().run_as("e", {"src": rel}, "slow", lambda out: out.df.select(slow("r")).write.format("noop").mode("overwrite").save())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(200):
        if progress(spark, "slow")[1]:
            break
        time.sleep(0.1)
    cancel(spark, "slow")
    thread.join(60)
    assert failed and not thread.is_alive()


def test_views(spark):
    rows = [(0, 0, x, 0.2, 0.2, 0.2, float(x in (1, 2))) for x in range(4)]
    rel = image_rel(spark.createDataFrame(rows, "frame_id int, y int, x int, r double, g double, b double, a double"), 4, 1)
    same = views.influence(rel, rel, "isolate").df.first()
    assert same.r == pytest.approx(0.2140411, abs=1e-6)
    assert [tuple(r) for r in views.bounds(rel, 0.5).collect()] == [(0, 1, 0, 2, 1)]
    assert sorted((r.x, r.a) for r in views.cut(rel, 0.5).collect()) == [(0, 1.0), (1, 1.0)]
