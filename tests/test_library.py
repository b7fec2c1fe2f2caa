import pytest
from pyspark.sql import functions as F

from rasterloom.sources.library import Filter, Library, LibraryError, NotFound, export_names, partial_span, shutter_seconds, table_sort


@pytest.fixture(scope="module")
def lib(spark):
    folders = spark.createDataFrame([(1, "/p", 5, 0, 0), (2, "/p/a", 9, 3, 0), (3, "/pa", 1, 4, 1)], "id bigint, path string, last_opened bigint, picked_at bigint, hidden int")
    images = spark.createDataFrame(
        [("i1", "/p/1.jpg", "1.jpg", "jpg", 1, 5, "pick", 0, 0), ("i2", "/p/a/2.dng", "2.dng", "dng", 2, 3, "none", 0, 1), ("i3", "/pa/3.jpg", "3.jpg", "jpg", 3, 4, "none", 0, 0), ("i4", "/p/4.jpg", "4.jpg", "jpg", 1, 1, "none", 1, 0), ("i5", "/x.jpg", "0.jpg", "jpg", None, 2, "none", 0, 0)],
        "id string, path string, file_name string, extension string, folder_id bigint, rating int, flag string, trashed int, hidden int",
    )
    keywords = spark.createDataFrame([("i1", "Sea"), ("i3", "sea"), ("i1", "Sky")], "image_id string, keyword string")
    return Library.empty(spark, folders=folders, images=images, keywords=keywords)


def ids(df):
    return [r[0] for r in df.select("id").collect()]


def test_listing_rules(lib):
    assert ids(lib.list_images()) == ["i5", "i1"]  # hidden, trashed and hidden folders' images are left out, folderless ones stay
    assert ids(lib.list_images(Filter(folder_id=3))) == ["i3"]
    assert ids(lib.list_images(Filter(include_hidden=True))) == ["i5", "i1", "i2"]
    assert ids(lib.list_images(Filter(keyword=" SEA "))) == ["i1"]
    assert ids(lib.list_images(Filter(min_rating=2, flag="pick", extension="JPG"))) == ["i1"]
    assert ids(lib.list_images(Filter(name_like="?.j*"))) == ["i5", "i1"]


def test_paths_go_by_components(lib):
    assert sorted(ids(lib.folder_scope("/p"))) == [1, 2]
    assert lib.scoped_counts("/p").first() == (2, 2)
    assert [r.path for r in lib.rename_folder_paths("/p", "/q").folders.orderBy("id").collect()] == ["/q", "/q/a", "/pa"]


def test_summaries_keep_empty_folders(lib):
    assert [(r.path, r.image_count) for r in lib.folder_summaries().collect()] == [("/p/a", 1), ("/p", 1)]
    assert [r.path for r in lib.recent_picked_folders(5).collect()] == ["/p/a"]


def test_updates_and_errors(lib):
    assert lib.set_rating("i1", 2).image("i1").first().rating == 2
    for bad in (lambda: lib.set_rating("i1", 6), lambda: lib.set_flag("i1", "maybe"), lambda: lib.create_collection(" ")):
        with pytest.raises(LibraryError):
            bad()
    with pytest.raises(NotFound):
        lib.set_trashed("nobody", True)
    got = lib.set_keywords("i1", [" Sun ", "sun", "", "Moon"]).keywords_of("i1").collect()
    assert [r.keyword for r in got] == ["Moon", "Sun"]
    assert [r.keyword for r in lib.all_keywords().collect()] == ["Sea", "Sky"]


def test_collections(lib):
    one = lib.create_collection("Best").add_to_collection(1, "i1").add_to_collection(1, "i1").add_to_collection(1, "i4")
    assert [(r.name, r.image_count) for r in one.collection_summaries().collect()] == [("Best", 1)]
    with pytest.raises(LibraryError):
        one.create_collection("best")
    gone, had = one.delete_collection(1)
    assert gone.members.count() == 0 and [r.image_id for r in had.collect()] == ["i1", "i4"]


def test_import_is_idempotent(lib):
    once = lib.import_from(lib)
    assert once.images.count() == 5 and once.folders.count() == 3 and once.keywords.count() == 3
    empty = Library.empty(lib.images.sparkSession)
    copy = empty.import_from(lib)
    assert sorted(ids(copy.images)) == sorted(ids(lib.images))
    names = {r.id: r.path for r in copy.folders.collect()}
    assert {r.id: names.get(r.folder_id) for r in copy.images.collect()} == {"i1": "/p", "i2": "/p/a", "i3": "/pa", "i4": "/p", "i5": None}


def test_flush_takes_dependents(lib):
    out = lib.flush_folder("/p")
    assert sorted(ids(out.images)) == ["i3", "i5"] and out.keywords.count() == 1 and ids(out.folders) == [3]


def test_snapshot(lib, spark, tmp_path):
    lib.save(str(tmp_path / "s"))
    assert sorted(ids(Library.open(spark, str(tmp_path / "s")).images)) == sorted(ids(lib.images))


def test_dates_sorts_and_names(lib, spark):
    assert partial_span("2024-02") == ("2024:02:01 00:00:00", "2024:02:29 23:59:59")
    with pytest.raises(LibraryError):
        partial_span("02/2024")
    df = spark.createDataFrame([("a", "1/250"), ("b", None), ("c", "0.5"), ("d", "junk"), ("e", "1/0")], "file_name string, shutter string").withColumn("s", shutter_seconds(F.col("shutter")))
    assert {r.file_name: r.s for r in df.collect()} == {"a": 0.004, "b": None, "c": 0.5, "d": None, "e": None}
    for down, want in ((False, "acbde"), (True, "cabde")):
        assert "".join(r.file_name for r in table_sort(df, F.col("s"), descending=down).collect()) == want
    got = export_names(lib.images, "{name}-{flag}-{what}").orderBy("n").collect()
    assert got[0].export_name == "0-none-{what}" and len({r.export_name for r in got}) == 5
    same = [r.export_name for r in export_names(lib.images, "x").orderBy("n").collect()]
    assert same == ["x", "x-2", "x-3", "x-4", "x-5"]


def test_own_work_is_each_id_once(spark):
    images = spark.createDataFrame([("a", 1, "none", 0), ("a", 0, "pick", 0), ("b", 0, "none", 1), ("c", 0, "none", 0), ("d", 0, "none", 0), (None, 2, "none", 0)], "id string, rating int, flag string, edited int")
    members = spark.createDataFrame([(1, "b"), (2, "b"), (1, "gone"), (1, "c")], "collection_id bigint, image_id string")
    keywords = spark.createDataFrame([("c", "Sea"), ("c", "Sky"), (None, "Sea"), ("a", "Sea")], "image_id string, keyword string")
    got = Library.empty(spark, images=images, members=members.distinct(), keywords=keywords.distinct()).image_has_own_work()
    assert got.columns == ["id"] and sorted(ids(got), key=str) == [None, "a", "b", "c", "gone"]


def test_own_work_makes_only_ids_distinct(spark, sf_dir, capsys):
    import re

    from rasterloom.queries.library import queries

    queries()["catalog__image_has_own_work"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan)
    assert keys and not [k for k in keys if "," in k]  # pairs of image and collection or keyword would fill a task's memory
    assert plan.count("Exchange hashpartitioning") == 3 and "REPARTITION_BY_NUM" in plan  # one a table, and none after


def test_rows_of_the_tables_are_distinct_as_numbers(spark, sf_dir, capsys):
    from rasterloom.queries.library import library

    lib = library(spark, sf_dir)
    for df, key in ((lib.members, "collection_id"), (lib.keywords, "keyword")):
        df.explain()
        assert "HashAggregate(keys=[l_" in (plan := capsys.readouterr().out) and "keys=[image_id" not in plan
        assert dict(df.dtypes)["image_id"] == "string" and df.count() == df.select(key, "image_id").distinct().count()
