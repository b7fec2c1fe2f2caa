"""Queries of the library, feature matching and journals over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import match
from rasterloom.sources.library import SCHEMAS, Filter, Library, export_names, is_pano, is_stack, is_supported, shutter_seconds
from rasterloom.session import numbered
from rasterloom.streaming.merge import journal_batch, running_merge

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(spark: SparkSession, sf_dir: str) -> Library:
    """Customers as folders under region and nation, orders as images, suppliers as collections, line flags as keywords."""
    t = lambda name: read(spark, sf_dir, name)
    folders = (
        t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .select(F.col("c_custkey").alias("id"), F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_name").alias("path"), (F.col("c_custkey") % 5).alias("last_opened"), (F.col("c_custkey") % 7).alias("picked_at"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("hidden"))
    )
    key = F.col("o_orderkey")
    images = t("orders").select(
        key.cast("string").alias("id"),
        F.concat(F.lit("/p/"), key.cast("string")).alias("path"),
        F.concat(F.lit("IMG_"), key.cast("string"), F.when(key % 3 == 0, ".dng").otherwise(".jpg")).alias("file_name"),
        F.when(key % 3 == 0, "dng").otherwise("jpg").alias("extension"),
        F.col("o_custkey").alias("folder_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
        F.when(F.col("o_orderstatus") == "P", "pick").when(F.col("o_orderstatus") == "F", "reject").otherwise("none").alias("flag"),
        F.when(key % 4 == 0, 1).otherwise(0).alias("edited"),
        F.when(key % 13 == 0, 1).otherwise(0).alias("hidden"),
        F.when(key % 11 == 0, 1).otherwise(0).alias("trashed"),
    )
    lines = t("lineitem")
    image_id = F.col("l_orderkey").cast("string").alias("image_id")  # after the rows are distinct: numbers take less memory
    members = lines.select("l_suppkey", "l_orderkey").distinct().select(F.col("l_suppkey").alias("collection_id"), image_id)
    keywords = lines.select("l_orderkey", F.lower(F.concat("l_returnflag", F.lit("-"), "l_linestatus")).alias("keyword")).distinct().select(image_id, "keyword")
    collections = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    thumbnails = t("orders").select(key.cast("string").alias("image_id"), F.when(key % 2 == 0, "rendered").otherwise("embedded").alias("kind"), F.col("o_orderpriority").cast("binary").alias("data"))
    exif = t("orders").select(key.cast("string").alias("image_id"), F.col("o_orderstatus").alias("make"), F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss").alias("taken"), F.lit(3).alias("reader"))
    dims = t("orders").select(key.cast("string").alias("image_id"), F.col("o_orderstatus").alias("source_key"), (key % 6000).cast("int").alias("width"), (key % 4000).cast("int").alias("height"))
    meta = t("nation").select(F.concat(F.lit("nation."), "n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return Library.empty(spark, folders=folders, images=images, members=members, keywords=keywords, collections=collections, thumbnails=thumbnails, exif=exif, decoded_dims=dims, meta=meta)


def of(function: Callable[[Library], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(library(spark, sf_dir))


def listed(f: Filter) -> Query:
    """A listing with each image's place in it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        shown = library(spark, sf_dir).list_images(f, ordered=False).select("id", "file_name", "folder_id", "rating", "flag", "edited")
        return numbered(shown, "file_name", "id", name="place")

    return query


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a library brought into the other half, with an overlap. Each half has some of the folders and collections, and the one brought in has other ids for them; images are shown with the paths and names they end up with."""
    lib = library(spark, sf_dir)
    key = F.col("id").cast("bigint")

    def part(keep, folders, collections, shift: int) -> Library:
        images = lib.images.filter(keep)
        ids = images.select(F.col("id").alias("image_id"))
        moved = lambda df, c: df.withColumn(c, F.col(c) + shift)
        return Library.empty(
            spark,
            folders=moved(lib.folders.filter(folders), "id"),
            collections=moved(lib.collections.filter(collections), "id"),
            images=moved(images, "folder_id"),
            keywords=lib.keywords.join(ids, "image_id", "left_semi"),
            members=moved(lib.members.join(ids, "image_id", "left_semi"), "collection_id"),
        )

    mine = part((key % 2 == 1) | (key % 10 == 0), F.col("id") % 3 != 0, F.col("id") % 4 != 0, 0)
    theirs = part(key % 2 == 0, F.lit(True), F.lit(True), 1_000_000)
    out = mine.import_from(theirs)
    words = out.keywords.groupBy(F.col("image_id").alias("id")).agg(F.count(F.lit(1)).alias("keywords"))
    held = out.members.join(out.collections.select(F.col("id").alias("collection_id"), "name"), "collection_id")
    members = held.groupBy(F.col("image_id").alias("id")).agg(F.count(F.lit(1)).alias("members"), F.min("name").alias("first_member"))
    placed = out.images.join(out.folders.select(F.col("id").alias("folder_id"), F.col("path").alias("folder")), "folder_id", "left").select("id", "folder_id", "folder")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return placed.join(words, "id", "left").join(members, "id", "left").select("id", "folder_id", "folder", count("keywords"), count("members"), "first_member")


def flushed(lib: Library) -> DataFrame:
    out = lib.flush_folder("/ASIA")
    return out.counts().crossJoin(out.keywords.agg(F.count(F.lit(1)).alias("keywords"))).crossJoin(out.members.agg(F.count(F.lit(1)).alias("members")))


def metadata_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as if they had shutter speeds, sorted by them with blanks last, and numbered."""
    size = F.col("p_size")
    df = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("file_name"), F.when(size % 5 == 0, F.lit(None)).when(size % 2 == 0, F.concat(F.lit("1/"), (size * 10).cast("string"))).otherwise((size / F.lit(10.0)).cast("string")).alias("shutter"))
    seconds = shutter_seconds(F.col("shutter"))
    ordered = numbered(df.withColumn("seconds", seconds), F.col("seconds").desc_nulls_last(), "file_name", "id", name="place")
    return ordered.select("id", F.round("seconds", 9).alias("seconds"), "place")


def feature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("desc"))
    out = match.match_features(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), 0.95)
    return out.select("a_id", "b_id", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames, each linked to the one before it of the same customer and priority."""
    from pyspark.sql import Window

    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), "o_custkey", "o_orderpriority")
    before = F.lag("frame").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("frame"))
    edges = orders.select(F.col("frame").alias("a"), before.alias("b")).filter("b is not null")
    return match.frame_groups(edges, orders.select("frame"))


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), (F.col("o_orderkey") % 40).alias("inliers"), (F.col("o_custkey") % 90).alias("in_overlap"))
    return match.verified(pairs)


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).cast("int").alias("frame_id"), F.hour("ts").alias("y"), F.dayofmonth("ts").alias("x")).agg(F.count(F.lit(1)).alias("w"))
    return match.owners(w)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = library(spark, sf_dir)
    return export_names(lib.list_images(Filter(min_rating=4, flag="pick"), ordered=False), "{flag}-{stars}").select("id", "n", "export_name")


def stored(lib: Library, table: str, row: tuple, key: list[str]) -> Library:
    """A row put into a table in place of the one with its key."""
    return lib.upsert(table, lib.images.sparkSession.createDataFrame([row], SCHEMAS[table]), key)


def endings(lib: Library) -> DataFrame:
    """Images as if every seventh were a panorama, every ninth a stack and every eleventh a text, told by their endings."""
    k = F.col("id").cast("bigint")
    ending = F.when(k % 7 == 0, "PANO").when(k % 9 == 0, "stack").when(k % 11 == 0, "txt").otherwise(F.col("extension"))
    return lib.images.select("id", ending.alias("e")).select("id", is_supported(F.col("e")).alias("supported"), is_pano(F.col("e")).alias("pano"), is_stack(F.col("e")).alias("stack"))


def grey_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' mean values by hour and day as frames, one for each of five groups of users."""
    e = read(spark, sf_dir, "events")
    v = F.round(F.avg("value"), 6)
    return e.groupBy((F.col("user_id") % 5).cast("int").alias("frame_id"), F.hour("ts").alias("y"), F.dayofmonth("ts").alias("x")).agg(v.alias("v"))


def overlap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = grey_frames(spark, sf_dir).select("frame_id", "y", "x", *[F.col("v").alias(c) for c in "rgb"], F.lit(1.0).alias("a"))
    return match.overlap_means(df).select("a", "b", "n", F.round("mean_a", 5).alias("mean_a"), F.round("mean_b", 5).alias("mean_b"))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running merge of frames, over all of them at once."""
    return running_merge(grey_frames(spark, sf_dir)).select("y", "x", F.round("v_mean", 5).alias("v_mean"), "v_max", "v_min", "v_n")


def in_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "part").select((F.col("p_partkey") % 1000).cast("double").alias("px"), (F.col("p_partkey") * 7 % 800).cast("double").alias("py"))
    return match.features_in_overlap(points, np.array([[1.0, 0.1, -200.0], [0.0, 1.0, 50.0], [0.0, 0.0005, 1.0]]), 600, 500)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "catalog__list_images": listed(Filter()),
        "catalog__list_images_rating": listed(Filter(min_rating=4)),
        "catalog__list_images_flag_ext": listed(Filter(flag="pick", extension="DNG", include_hidden=True)),
        "catalog__list_images_folder": listed(Filter(folder_id=7)),
        "catalog__list_images_collection": listed(Filter(collection_id=3)),
        "catalog__list_images_keyword": listed(Filter(keyword=" N-O ")),
        "catalog__list_images_name": listed(Filter(name_like="img_1?*.jpg", edited=True)),
        "catalog__list_trashed": of(lambda lib: lib.list_trashed().select("id", "folder_id", "file_name")),
        "catalog__list_folders": of(lambda lib: lib.list_folders()),
        "catalog__hidden_folder_paths": of(lambda lib: lib.hidden_folder_paths()),
        "catalog__folder_summaries": of(lambda lib: lib.folder_summaries()),
        "catalog__recent_picked_folders": of(lambda lib: lib.recent_picked_folders(10)),
        "catalog__folder_scope": of(lambda lib: lib.folder_scope("/ASIA")),
        "catalog__subtree_images": of(lambda lib: lib.scoped_images("/EUROPE")),
        "catalog__subtree_counts": of(lambda lib: lib.scoped_counts("/ASIA")),
        "catalog__subtree_trashed_count": of(lambda lib: lib.scoped_counts("/ASIA", trashed=1)),
        "catalog__edited_folder_paths": of(lambda lib: lib.edited_folder_paths()),
        "catalog__folders_with_hidden": of(lambda lib: lib.folders_with_hidden()),
        "catalog__folders_with_trash": of(lambda lib: lib.folders_with_trash()),
        "catalog__all_keywords": of(lambda lib: lib.all_keywords()),
        "catalog__list_collections": of(lambda lib: lib.list_collections().select("id", "name")),
        "catalog__collection_summaries": of(lambda lib: lib.collection_summaries().select("id", "name", "image_count")),
        "catalog__counts": of(lambda lib: lib.counts()),
        "catalog__image_has_own_work": of(lambda lib: lib.image_has_own_work()),
        "catalog__rename_folder_paths": of(lambda lib: lib.rename_folder_paths("/ASIA", "/ORIENT").folders.select("id", "path")),
        "catalog__recover_hidden": of(lambda lib: lib.recover_hidden("/ASIA/NATION_17/Customer#000000007").images.filter("hidden = 1").select("id")),
        "catalog__flush_folder": of(flushed),
        "catalog__import_from": imported,
        "catalog__metadata_sort": metadata_sort,
        "catalog__export_names": exported,
        "catalog__image": of(lambda lib: lib.image("7").select("id", "path", "rating")),
        "catalog__folder_id": of(lambda lib: lib.folder_id("/ASIA/NATION_17/Customer#000000007")),
        "catalog__folder_spelling_candidates": of(lambda lib: lib.folder_spelling_candidates("/asia/nation_17/customer#000000007")),
        "catalog__meta": of(lambda lib: lib.meta_value("nation.NATION_7")),
        "catalog__meta_keys": of(lambda lib: lib.meta_keys("nation.NATION_1")),
        "catalog__delete_meta": of(lambda lib: lib.delete_meta("nation.NATION_7").meta),
        "catalog__recovery_inventory": of(lambda lib: lib.recovery_inventory()),
        "catalog__irreplaceable_bytes": of(lambda lib: lib.irreplaceable_bytes()),
        "catalog__stats": of(lambda lib: lib.stats()),
        "catalog__add_image": of(lambda lib: lib.add_image("new", "/p/New One.JPG", 7, 5).images.select("id", "path", "file_name", "extension", "folder_id")),
        "catalog__set_image_path": of(lambda lib: lib.set_image_path("7", "/q/Other.TIF", 9).images.select("id", "path", "file_name", "extension", "folder_id")),
        "catalog__assign_folder_if_elsewhere": of(lambda lib: lib.assign_folder_if_elsewhere("7", 9)[0].images.select("id", "folder_id")),
        "catalog__image_id_taken": of(lambda lib: lib.image_id_taken("7")),
        "catalog__image_id_by_path": of(lambda lib: lib.image_id_by_path("/p/7")),
        "catalog__is_trashed": of(lambda lib: lib.is_trashed("33")),
        "catalog__is_hidden": of(lambda lib: lib.is_hidden("26")),
        "catalog__hidden_ids_in_folder": of(lambda lib: lib.hidden_ids_in_folder(7)),
        "catalog__decoded_dimensions": of(lambda lib: lib.decoded_dimensions("7", "F").union(lib.decoded_dimensions("7", "O")).union(lib.decoded_dimensions("7", "P"))),
        "catalog__thumbnail": of(lambda lib: lib.thumbnail("7").select("kind", F.col("data").cast("string").alias("data"))),
        "catalog__clear_thumbnail": of(lambda lib: lib.clear_thumbnail("7").thumbnails.select("image_id", "kind")),
        "catalog__clear_rendered_thumbnails": of(lambda lib: lib.clear_rendered_thumbnails().thumbnails.select("image_id", "kind")),
        "catalog__clear_thumbnails": of(lambda lib: lib.clear_thumbnails().thumbnails.agg(F.count(F.lit(1)).alias("n"))),
        "catalog__exif": of(lambda lib: lib.exif_of("7").select("make", "taken", "reader")),
        "catalog__exif_for_folder": of(lambda lib: lib.exif_for_folder(7).select("image_id", "make", "taken")),
        "catalog__list_images_taken": listed(Filter(taken=("1995-03", "1995-04"))),
        "catalog__rename_collection": of(lambda lib: lib.rename_collection(3, "Best of all").collections.select("id", "name")),
        "catalog__set_collection_graph": of(lambda lib: lib.set_collection_graph(3, "g-1").collections.select("id", "graph_id")),
        "catalog__delete_collection": of(lambda lib: lib.delete_collection(3)[0].collection_summaries().select("id", "name", "image_count")),
        "catalog__restore_collection": of(lambda lib: lib.delete_collection(3)[0].restore_collection(3, "Back", None, lib.delete_collection(3)[1]).collection_summaries().select("id", "name", "image_count")),
        "catalog__set_keywords": of(lambda lib: lib.set_keywords("7", [" Sun ", "sun", "Moon"]).keywords),
        "catalog__set_rating": of(lambda lib: lib.set_rating("7", 5).images.select("id", "rating")),
        "catalog__set_flag": of(lambda lib: lib.set_flag("7", "reject").images.select("id", "flag")),
        "catalog__set_link_group": of(lambda lib: lib.set_link_group(["7", "32"], "l1").images.select("id", "link_group")),
        "catalog__hide_folder": of(lambda lib: lib.hide_folder("/ASIA/NATION_17/Customer#000000007").hidden_folder_paths()),
        "catalog__absorb_image": of(lambda lib: lib.absorb_image("7", "32").keywords),
        "catalog__add_folder": of(lambda lib: lib.add_folder("/NEW").folders.select("id", "path", "hidden")),
        "catalog__forget_images": of(lambda lib: lib.forget_images(lib.images.filter("trashed = 1").select("id")).keywords),
        "catalog__set_edited": of(lambda lib: lib.set_edited("7").images.select("id", "edited")),
        "catalog__clear_edited": of(lambda lib: lib.set_edited("32", False).images.select("id", "edited")),
        "catalog__set_hidden": of(lambda lib: lib.set_hidden("7", True).images.select("id", "hidden")),
        "catalog__set_trashed": of(lambda lib: lib.set_trashed("7", True).images.select("id", "trashed")),
        "catalog__set_dimensions": of(lambda lib: lib.set_dimensions("7", 600, 400).images.filter("width is not null").select("id", "width", "height")),
        "catalog__assign_folder": of(lambda lib: lib.assign_folder("7", 9).images.select("id", "folder_id")),
        "catalog__touch_folder": of(lambda lib: lib.touch_folder(7, 99).folders.select("id", "last_opened")),
        "catalog__pick_folder": of(lambda lib: lib.pick_folder(7, 99).folders.select("id", "picked_at")),
        "catalog__trashed_count": of(lambda lib: lib.count_in("/ASIA/NATION_17/Customer#000000007", "trashed = 1")),
        "catalog__hidden_count": of(lambda lib: lib.count_in("/ASIA/NATION_17/Customer#000000007", "hidden = 1")),
        "catalog__keywords_of": of(lambda lib: lib.keywords_of("7")),
        "catalog__create_collection": of(lambda lib: lib.create_collection(" New ").collections.select("id", "name")),
        "catalog__add_to_collection": of(lambda lib: lib.add_to_collection(3, "7").add_to_collection(3, "7").members),
        "catalog__remove_from_collection": of(lambda lib: lib.add_to_collection(3, "7").remove_from_collection(3, "7").members),
        "catalog__store_thumbnail": of(lambda lib: stored(lib, "thumbnails", ("7", "rendered", bytearray(b"new"), 5), ["image_id"]).thumbnails.select("image_id", "kind", F.col("data").cast("string").alias("data"))),
        "catalog__put_exif": of(lambda lib: stored(lib, "exif", ("7", "Make", None, None, None, None, None, None, "2024:01:02 03:04:05", 5, 4), ["image_id"]).exif.select("image_id", "make", "taken", "reader")),
        "catalog__set_meta": of(lambda lib: stored(lib, "meta", ("nation.NATION_7", "new"), ["key"]).meta),
        "catalog__set_decoded_dimensions": of(lambda lib: stored(lib, "decoded_dims", ("7", "F", 1, 2), ["image_id", "source_key"]).decoded_dims),
        "catalog__remove_image": of(lambda lib: lib.forget_images(lib.image("7").select("id")).images.select("id")),
        "catalog__extensions": of(endings),
        "match__overlap_means": overlap_means,
        "match__features_in_overlap": in_overlap,
        "merge__running": merged,
        "match__features": feature_match,
        "match__verify": verified,
        "match__components": frame_groups,
        "match__ownership": owners,
        "journal__replay": lambda spark, sf_dir: journal_batch(read(spark, sf_dir, "events")),
    }
    return out


FOLDERS = "folders AS (SELECT c_custkey AS id, concat('/', r_name, '/', n_name, '/', c_name) AS path, c_custkey % 5 AS last_opened, c_custkey % 7 AS picked_at, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS hidden FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"
IMAGES = "images AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, concat('/p/', o_orderkey) AS path, concat('IMG_', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '.dng' ELSE '.jpg' END) AS file_name, CASE WHEN o_orderkey % 3 = 0 THEN 'dng' ELSE 'jpg' END AS extension, o_custkey AS folder_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating, CASE o_orderstatus WHEN 'P' THEN 'pick' WHEN 'F' THEN 'reject' ELSE 'none' END AS flag, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS edited, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS hidden, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS trashed FROM orders)"
REST = "members AS (SELECT DISTINCT l_suppkey AS collection_id, CAST(l_orderkey AS VARCHAR) AS image_id FROM lineitem), keywords AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS image_id, lower(concat(l_returnflag, '-', l_linestatus)) AS keyword FROM lineitem)"
BASE = f"WITH {FOLDERS}, {IMAGES}, {REST} "
ROWS = "SELECT id, file_name, folder_id, rating, flag, edited, CAST(row_number() OVER (ORDER BY file_name, id) AS INTEGER) AS place FROM images i"
EXIF = "exif AS (SELECT CAST(o_orderkey AS VARCHAR) AS image_id, o_orderstatus AS make, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS taken, CAST(3 AS BIGINT) AS reader, o_custkey AS folder_id FROM orders)"
THUMBS = "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, CASE WHEN o_orderkey % 2 = 0 THEN 'rendered' ELSE 'embedded' END AS kind FROM orders"
META = "SELECT concat('nation.', n_name) AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation"
SEEN = "(folder_id IS NULL OR folder_id NOT IN (SELECT id FROM folders WHERE hidden = 1))"


GREY = "SELECT CAST(user_id % 5 AS INTEGER) AS frame_id, CAST(hour(ts) AS INTEGER) AS y, CAST(day(ts) AS INTEGER) AS x, round(avg(value), 6) AS v FROM events GROUP BY ALL"
LIGHT = "(CAST(0.2126 AS DOUBLE) * {0} + CAST(0.7152 AS DOUBLE) * {0} + CAST(0.0722 AS DOUBLE) * {0})"
#: Each user's events in turn, with the values that are set (done) and those that were taken back (undone) as lists.
JOURNAL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST([] AS DOUBLE[]) AS done, CAST([] AS DOUBLE[]) AS undone, false AS moved FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT e.user_id, e.k, e.event_id,
 CASE WHEN event_type = 'click' THEN list_append(done, value) WHEN event_type = 'error' AND len(done) > 0 THEN done[:-2] WHEN event_type = 'signup' AND len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END,
 CASE WHEN event_type = 'click' THEN [] WHEN event_type = 'error' AND len(done) > 0 THEN list_append(undone, done[-1]) WHEN event_type = 'signup' AND len(undone) > 0 THEN undone[:-2] ELSE undone END,
 event_type = 'click' OR (event_type = 'error' AND len(done) > 0) OR (event_type = 'signup' AND len(undone) > 0)
FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, CASE WHEN len(done) > 0 THEN done[-1] END AS value, CAST(len(done) AS BIGINT) AS depth, CAST(len(undone) AS BIGINT) AS undone FROM r WHERE moved"""


def oracle_sql() -> dict[str, str]:
    live = "trashed = 0 AND hidden = 0"
    scope = lambda p: f"(path = '{p}' OR starts_with(path, '{p}/'))"
    summary = "SELECT f.id, f.path, f.last_opened, count(i.id) AS image_count FROM folders f LEFT JOIN images i ON i.folder_id = f.id AND i.trashed = 0 WHERE f.hidden = 0"
    held = "SELECT s_suppkey AS id, s_name AS name, count(i.id) AS image_count FROM supplier LEFT JOIN members m ON m.collection_id = s_suppkey LEFT JOIN images i ON i.id = m.image_id AND i.trashed = 0"
    restored = "CASE WHEN s_suppkey = 3 THEN 'Back' ELSE s_name END AS name"
    return {
        "catalog__list_images": f"{BASE}{ROWS} WHERE {live} AND {SEEN}",
        "catalog__list_images_rating": f"{BASE}{ROWS} WHERE {live} AND rating >= 4 AND {SEEN}",
        "catalog__list_images_flag_ext": f"{BASE}{ROWS} WHERE trashed = 0 AND flag = 'pick' AND extension = 'dng' AND {SEEN}",
        "catalog__list_images_folder": f"{BASE}{ROWS} WHERE {live} AND folder_id = 7",
        "catalog__list_images_collection": f"{BASE}{ROWS} WHERE {live} AND {SEEN} AND id IN (SELECT image_id FROM members WHERE collection_id = 3)",
        "catalog__list_images_keyword": f"{BASE}{ROWS} WHERE {live} AND {SEEN} AND id IN (SELECT image_id FROM keywords WHERE keyword = 'n-o')",
        "catalog__list_images_name": f"{BASE}{ROWS} WHERE {live} AND {SEEN} AND edited = 1 AND regexp_matches(lower(file_name), '^img_1..*[.]jpg$')",
        "catalog__list_trashed": f"{BASE}SELECT id, folder_id, file_name FROM images WHERE trashed = 1",
        "catalog__list_folders": f"{BASE}SELECT id, path FROM folders",
        "catalog__hidden_folder_paths": f"{BASE}SELECT path FROM folders WHERE hidden = 1",
        "catalog__folder_summaries": f"{BASE}{summary} GROUP BY ALL",
        "catalog__recent_picked_folders": f"{BASE}SELECT id, path, last_opened, image_count FROM ({summary.replace('count(i.id)', 'f.picked_at, count(i.id)')} AND picked_at > 0 GROUP BY ALL) ORDER BY picked_at DESC, path LIMIT 10",
        "catalog__folder_scope": f"{BASE}SELECT id, path FROM folders WHERE {scope('/ASIA')}",
        "catalog__subtree_images": f"{BASE}SELECT id, path FROM images WHERE folder_id IN (SELECT id FROM folders WHERE {scope('/EUROPE')})",
        "catalog__subtree_counts": f"{BASE}SELECT (SELECT count(*) FROM folders WHERE {scope('/ASIA')}) AS folders, (SELECT count(*) FROM images WHERE trashed = 0 AND folder_id IN (SELECT id FROM folders WHERE {scope('/ASIA')})) AS images",
        "catalog__subtree_trashed_count": f"{BASE}SELECT (SELECT count(*) FROM folders WHERE {scope('/ASIA')}) AS folders, (SELECT count(*) FROM images WHERE trashed = 1 AND folder_id IN (SELECT id FROM folders WHERE {scope('/ASIA')})) AS images",
        "catalog__edited_folder_paths": f"{BASE}SELECT DISTINCT f.path FROM folders f JOIN images i ON i.folder_id = f.id WHERE i.edited = 1 AND i.trashed = 0",
        "catalog__folders_with_hidden": f"{BASE}SELECT DISTINCT f.path FROM folders f JOIN images i ON i.folder_id = f.id WHERE i.hidden = 1 AND i.trashed = 0",
        "catalog__folders_with_trash": f"{BASE}SELECT DISTINCT f.path FROM folders f JOIN images i ON i.folder_id = f.id WHERE i.trashed = 1",
        "catalog__all_keywords": f"{BASE}SELECT DISTINCT keyword FROM keywords",
        "catalog__list_collections": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
        "catalog__collection_summaries": f"{BASE}SELECT s_suppkey AS id, s_name AS name, count(i.id) AS image_count FROM supplier LEFT JOIN members m ON m.collection_id = s_suppkey LEFT JOIN images i ON i.id = m.image_id AND i.trashed = 0 GROUP BY ALL",
        "catalog__counts": "SELECT (SELECT count(*) FROM customer) AS folders, (SELECT count(*) FROM orders) AS images, (SELECT count(*) FROM supplier) AS collections",
        "catalog__image_has_own_work": f"{BASE}SELECT id FROM images WHERE rating > 0 OR flag <> 'none' OR edited = 1 UNION SELECT image_id FROM members UNION SELECT image_id FROM keywords",
        "catalog__rename_folder_paths": f"{BASE}SELECT id, CASE WHEN {scope('/ASIA')} THEN concat('/ORIENT', substr(path, 6)) ELSE path END AS path FROM folders",
        "catalog__recover_hidden": f"{BASE}SELECT id FROM images WHERE hidden = 1 AND (folder_id IS NULL OR folder_id NOT IN (SELECT id FROM folders WHERE path = '/ASIA/NATION_17/Customer#000000007'))",
        "catalog__flush_folder": f"{BASE}, gone AS (SELECT id FROM images WHERE folder_id IN (SELECT id FROM folders WHERE {scope('/ASIA')})) SELECT (SELECT count(*) FROM folders WHERE NOT {scope('/ASIA')}) AS folders, (SELECT count(*) FROM images WHERE id NOT IN (SELECT id FROM gone)) AS images, (SELECT count(*) FROM supplier) AS collections, (SELECT count(*) FROM keywords WHERE image_id NOT IN (SELECT id FROM gone)) AS keywords, (SELECT count(*) FROM members WHERE image_id NOT IN (SELECT id FROM gone)) AS members",
        "catalog__import_from": f"{BASE}, mine AS (SELECT id, path FROM folders WHERE id % 3 <> 0), fresh AS (SELECT path, (SELECT max(id) FROM mine) + row_number() OVER (ORDER BY path) AS id FROM folders WHERE id % 3 = 0), both_ AS (SELECT id, path FROM mine UNION ALL SELECT id, path FROM fresh), placed AS (SELECT i.id, CASE WHEN k % 2 = 1 OR k % 10 = 0 THEN i.folder_id ELSE b.id END AS folder_id FROM images i JOIN folders f ON f.id = i.folder_id LEFT JOIN both_ b ON b.path = f.path), had AS (SELECT m.image_id, s_name, s_suppkey % 4 <> 0 OR k % 2 = 0 AS kept FROM members m JOIN images i ON i.id = m.image_id JOIN supplier ON s_suppkey = m.collection_id) SELECT p.id, p.folder_id, b.path AS folder, (SELECT count(*) FROM keywords WHERE image_id = p.id) AS keywords, (SELECT count(*) FROM had WHERE image_id = p.id AND kept) AS members, (SELECT min(s_name) FROM had WHERE image_id = p.id AND kept) AS first_member FROM placed p LEFT JOIN both_ b ON b.id = p.folder_id",
        "catalog__metadata_sort": "WITH t AS (SELECT p_partkey AS id, p_name, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN CAST(1 AS DOUBLE) / (p_size * 10) ELSE p_size / CAST(10 AS DOUBLE) END AS seconds FROM part) SELECT id, round(seconds, 9) AS seconds, CAST(row_number() OVER (ORDER BY seconds DESC NULLS LAST, p_name, id) AS INTEGER) AS place FROM t",
        "catalog__export_names": f"{BASE}, l AS (SELECT *, CAST(row_number() OVER (ORDER BY file_name, id) AS INTEGER) AS n, concat(flag, '-', rating) AS base FROM images WHERE {live} AND rating >= 4 AND flag = 'pick' AND {SEEN}), m AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY n) AS again FROM l) SELECT id, n, CASE WHEN again > 1 THEN concat(base, '-', again) ELSE base END AS export_name FROM m",
        "match__features": "WITH p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1), k AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS n FROM p) SELECT u.a_id, u.b_id, round(u.d, 6) AS d1, round(v.d, 6) AS d2 FROM k u JOIN k v ON u.a_id = v.a_id AND u.n = 1 AND v.n = 2 WHERE v.d > 1e-12 AND u.d / v.d < 0.95",
        "catalog__irreplaceable_bytes": """WITH folders AS (SELECT c_custkey AS id, '/' || r_name || '/' || n_name || '/' || c_name AS path, c_custkey % 5 AS o, c_custkey % 7 AS p, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS h FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
            texts AS (SELECT concat(id, path, o, p, h) AS t FROM folders
            UNION ALL SELECT concat(o_orderkey, '/p/', o_orderkey, 'IMG_', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '.dngdng' ELSE '.jpgjpg' END, o_custkey, substr(o_orderpriority, 1, 1), CASE o_orderstatus WHEN 'P' THEN 'pick' WHEN 'F' THEN 'reject' ELSE 'none' END, '0000') FROM orders
            UNION ALL SELECT concat(s_suppkey, s_name) FROM supplier
            UNION ALL SELECT DISTINCT concat(l_suppkey, ' ', l_orderkey) FROM lineitem
            UNION ALL SELECT DISTINCT concat(l_orderkey, ' ', l_returnflag, '-', l_linestatus) FROM lineitem
            UNION ALL SELECT concat(o_orderkey, o_orderstatus, '0000:00:00 00:00:00', 3) FROM orders
            UNION ALL SELECT concat(o_orderkey, o_orderstatus, o_orderkey % 6000, o_orderkey % 4000) FROM orders
            UNION ALL SELECT concat('nation.', n_name, n_regionkey) FROM nation)
            SELECT CAST(sum(strlen(t)) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem)) AS BIGINT) AS bytes FROM texts""",
        "match__verify": "SELECT o_orderkey AS a, o_custkey AS b, o_orderkey % 40 AS inliers, o_custkey % 90 AS in_overlap FROM orders WHERE o_orderkey % 40 > 8 + CAST(0.3 AS DOUBLE) * (o_custkey % 90)",
        "match__components": "SELECT o_orderkey AS frame, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS grp FROM orders",
        "match__ownership": "WITH t AS (SELECT CAST(user_id % 5 AS INTEGER) AS frame_id, CAST(hour(ts) AS INTEGER) AS y, CAST(day(ts) AS INTEGER) AS x, count(*) AS w FROM events GROUP BY ALL) SELECT y, x, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY w DESC, frame_id) AS k FROM t) WHERE k = 1",
        "catalog__image": f"{BASE}SELECT id, path, rating FROM images WHERE k = 7",
        "catalog__folder_id": f"{BASE}SELECT id FROM folders WHERE path = '/ASIA/NATION_17/Customer#000000007'",
        "catalog__folder_spelling_candidates": f"{BASE}SELECT path FROM folders WHERE path <> '/asia/nation_17/customer#000000007' AND lower(path) LIKE '%/customer#000000007'",
        "catalog__meta": f"SELECT value FROM ({META}) WHERE key = 'nation.NATION_7'",
        "catalog__meta_keys": f"SELECT key FROM ({META}) WHERE starts_with(key, 'nation.NATION_1')",
        "catalog__delete_meta": f"SELECT key, value FROM ({META}) WHERE key <> 'nation.NATION_7'",
        "catalog__recovery_inventory": f"{BASE}SELECT id, path, trashed = 1 AS trashed FROM images",
        "catalog__stats": "SELECT count(*) AS thumbnails, CAST(sum(octet_length(encode(o_orderpriority))) AS BIGINT) AS thumbnail_bytes FROM orders",
        "catalog__add_image": f"{BASE}SELECT id, path, file_name, extension, folder_id FROM images UNION ALL SELECT 'new', '/p/New One.JPG', 'New One.JPG', 'jpg', 7",
        "catalog__set_image_path": f"{BASE}SELECT id, CASE WHEN k = 7 THEN '/q/Other.TIF' ELSE path END AS path, CASE WHEN k = 7 THEN 'Other.TIF' ELSE file_name END AS file_name, CASE WHEN k = 7 THEN 'tif' ELSE extension END AS extension, CASE WHEN k = 7 THEN 9 ELSE folder_id END AS folder_id FROM images",
        "catalog__assign_folder_if_elsewhere": f"{BASE}SELECT id, CASE WHEN k = 7 THEN 9 ELSE folder_id END AS folder_id FROM images",
        "catalog__image_id_taken": f"{BASE}SELECT count(*) > 0 AS taken FROM images WHERE k = 7",
        "catalog__image_id_by_path": f"{BASE}SELECT id FROM images WHERE path = '/p/7'",
        "catalog__is_trashed": f"{BASE}SELECT id, trashed = 1 AS trashed FROM images WHERE k = 33",
        "catalog__is_hidden": f"{BASE}SELECT id, hidden = 1 AS hidden FROM images WHERE k = 26",
        "catalog__hidden_ids_in_folder": f"{BASE}SELECT id FROM images WHERE folder_id = 7 AND hidden = 1",
        "catalog__decoded_dimensions": "SELECT CAST(o_orderkey % 6000 AS INTEGER) AS width, CAST(o_orderkey % 4000 AS INTEGER) AS height FROM orders WHERE o_orderkey = 7",
        "catalog__thumbnail": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'rendered' ELSE 'embedded' END AS kind, o_orderpriority AS data FROM orders WHERE o_orderkey = 7",
        "catalog__clear_thumbnail": f"SELECT image_id, kind FROM ({THUMBS}) WHERE image_id <> '7'",
        "catalog__clear_rendered_thumbnails": f"SELECT image_id, kind FROM ({THUMBS}) WHERE kind <> 'rendered'",
        "catalog__clear_thumbnails": "SELECT CAST(0 AS BIGINT) AS n",
        "catalog__exif": f"WITH {EXIF} SELECT make, taken, reader FROM exif WHERE image_id = '7'",
        "catalog__exif_for_folder": f"WITH {EXIF} SELECT image_id, make, taken FROM exif WHERE folder_id = 7",
        "catalog__list_images_taken": f"{BASE}, {EXIF} {ROWS} WHERE {live} AND {SEEN} AND id IN (SELECT image_id FROM exif WHERE taken BETWEEN '1995:03:01 00:00:00' AND '1995:04:30 23:59:59')",
        "catalog__rename_collection": "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'Best of all' ELSE s_name END AS name FROM supplier",
        "catalog__set_collection_graph": "SELECT s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN 'g-1' END AS graph_id FROM supplier",
        "catalog__delete_collection": f"{BASE}{held} WHERE s_suppkey <> 3 GROUP BY ALL",
        "catalog__restore_collection": f"{BASE}{held.replace('s_name AS name', restored)} GROUP BY ALL",
        "catalog__set_keywords": f"{BASE}SELECT image_id, keyword FROM keywords WHERE image_id <> '7' UNION ALL SELECT '7', 'Sun' UNION ALL SELECT '7', 'Moon'",
        "catalog__set_rating": f"{BASE}SELECT id, CASE WHEN k = 7 THEN 5 ELSE rating END AS rating FROM images",
        "catalog__set_flag": f"{BASE}SELECT id, CASE WHEN k = 7 THEN 'reject' ELSE flag END AS flag FROM images",
        "catalog__set_link_group": f"{BASE}SELECT id, CASE WHEN k IN (7, 32) THEN 'l1' END AS link_group FROM images",
        "catalog__hide_folder": f"{BASE}SELECT path FROM folders WHERE hidden = 1 OR path = '/ASIA/NATION_17/Customer#000000007'",
        "catalog__absorb_image": f"{BASE}SELECT DISTINCT CASE WHEN image_id = '32' THEN '7' ELSE image_id END AS image_id, keyword FROM keywords",
        "catalog__add_folder": f"{BASE}SELECT id, path, hidden FROM folders UNION ALL SELECT (SELECT max(id) FROM folders) + 1, '/NEW', 0",
        "catalog__forget_images": f"{BASE}SELECT image_id, keyword FROM keywords WHERE image_id NOT IN (SELECT id FROM images WHERE trashed = 1)",
        "catalog__set_edited": f"{BASE}SELECT id, CASE WHEN k = 7 THEN 1 ELSE edited END AS edited FROM images",
        "catalog__clear_edited": f"{BASE}SELECT id, CASE WHEN k = 32 THEN 0 ELSE edited END AS edited FROM images",
        "catalog__set_hidden": f"{BASE}SELECT id, CASE WHEN k = 7 THEN 1 ELSE hidden END AS hidden FROM images",
        "catalog__set_trashed": f"{BASE}SELECT id, CASE WHEN k = 7 THEN 1 ELSE trashed END AS trashed FROM images",
        "catalog__set_dimensions": f"{BASE}SELECT id, 600 AS width, 400 AS height FROM images WHERE k = 7",
        "catalog__assign_folder": f"{BASE}SELECT id, CASE WHEN k = 7 THEN 9 ELSE folder_id END AS folder_id FROM images",
        "catalog__touch_folder": f"{BASE}SELECT id, CASE WHEN id = 7 THEN 99 ELSE last_opened END AS last_opened FROM folders",
        "catalog__pick_folder": f"{BASE}SELECT id, CASE WHEN id = 7 THEN 99 ELSE picked_at END AS picked_at FROM folders",
        "catalog__trashed_count": f"{BASE}SELECT count(*) AS n FROM images WHERE trashed = 1 AND folder_id IN (SELECT id FROM folders WHERE path = '/ASIA/NATION_17/Customer#000000007')",
        "catalog__hidden_count": f"{BASE}SELECT count(*) AS n FROM images WHERE hidden = 1 AND folder_id IN (SELECT id FROM folders WHERE path = '/ASIA/NATION_17/Customer#000000007')",
        "catalog__keywords_of": f"{BASE}SELECT keyword FROM keywords WHERE image_id = '7'",
        "catalog__create_collection": "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + 1, 'New'",
        "catalog__add_to_collection": f"{BASE}SELECT collection_id, image_id FROM members UNION SELECT 3, '7'",
        "catalog__remove_from_collection": f"{BASE}SELECT collection_id, image_id FROM members WHERE NOT (collection_id = 3 AND image_id = '7')",
        "catalog__store_thumbnail": "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey = 7 THEN 'rendered' ELSE 'embedded' END AS kind, CASE WHEN o_orderkey = 7 THEN 'new' ELSE o_orderpriority END AS data FROM orders",
        "catalog__put_exif": f"WITH {EXIF} SELECT image_id, CASE WHEN image_id = '7' THEN 'Make' ELSE make END AS make, CASE WHEN image_id = '7' THEN '2024:01:02 03:04:05' ELSE taken END AS taken, CASE WHEN image_id = '7' THEN 4 ELSE reader END AS reader FROM exif",
        "catalog__set_meta": f"SELECT key, CASE WHEN key = 'nation.NATION_7' THEN 'new' ELSE value END AS value FROM ({META})",
        "catalog__set_decoded_dimensions": "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, o_orderstatus AS source_key, CAST(o_orderkey % 6000 AS INTEGER) AS width, CAST(o_orderkey % 4000 AS INTEGER) AS height FROM orders WHERE NOT (o_orderkey = 7 AND o_orderstatus = 'F') UNION ALL SELECT '7', 'F', 1, 2",
        "catalog__remove_image": f"{BASE}SELECT id FROM images WHERE k <> 7",
        "catalog__extensions": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 OR o_orderkey % 11 <> 0 AS supported, o_orderkey % 7 = 0 AS pano, o_orderkey % 7 <> 0 AND o_orderkey % 9 = 0 AS stack FROM orders",
        "match__overlap_means": f"WITH g AS ({GREY}) SELECT p.frame_id AS a, q.frame_id AS b, count(*) AS n, round(avg({LIGHT.format('p.v')}), 5) AS mean_a, round(avg({LIGHT.format('q.v')}), 5) AS mean_b FROM g p JOIN g q ON p.y = q.y AND p.x = q.x AND p.frame_id < q.frame_id WHERE p.v IS NOT NULL GROUP BY ALL",
        "match__features_in_overlap": "WITH t AS (SELECT CAST(p_partkey % 1000 AS DOUBLE) AS px, CAST(p_partkey * 7 % 800 AS DOUBLE) AS py FROM part), u AS (SELECT (px + CAST(0.1 AS DOUBLE) * py - 200) / (CAST(0.0005 AS DOUBLE) * py + 1) AS x, (py + 50) / (CAST(0.0005 AS DOUBLE) * py + 1) AS y FROM t) SELECT count(*) FILTER (x BETWEEN 0 AND 600 AND y BETWEEN 0 AND 500) AS n FROM u",
        "merge__running": f"WITH g AS ({GREY}) SELECT y, x, round(avg(v), 5) AS v_mean, max(v) AS v_max, min(v) AS v_min, count(v) AS v_n FROM g GROUP BY y, x",
        "journal__replay": JOURNAL,
    }
