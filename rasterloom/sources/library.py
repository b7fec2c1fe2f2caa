"""The picture library as tables: listings, scopes, counts, updates, imports and snapshots.

A library is a value: every update returns a new one whose tables are built lazily, and nothing is written until ``save``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import checkpointed, numbered

VERSION, VERSION_KEY = 18, "schema_version"
FLAGS = ("none", "pick", "reject")
SCHEMAS = {
    "folders": "id bigint, path string, last_opened bigint, picked_at bigint, hidden int",
    "images": "id string, path string, file_name string, extension string, folder_id bigint, rating int, flag string, width int, height int, added_at bigint, edited int, hidden int, trashed int, link_group string",
    "collections": "id bigint, name string, graph_id string",
    "members": "collection_id bigint, image_id string",
    "thumbnails": "image_id string, kind string, data binary, updated_at bigint",
    "exif": "image_id string, make string, model string, lens string, focal string, aperture string, shutter string, iso string, taken string, read_at bigint, reader bigint",
    "keywords": "image_id string, keyword string",
    "decoded_dims": "image_id string, source_key string, width int, height int",
    "meta": "key string, value string",
}
DEPENDENT = ("members", "thumbnails", "exif", "keywords", "decoded_dims")
#: File endings by what they are.
PANORAMAS, STACKS = ("pano",), ("stack",)
PICTURES = ("jpg", "jpeg", "png", "tif", "tiff", "webp", "heic", "heif", "exr", "dng", "raw", "arw", "cr2", "cr3", "nef", "nrw", "orf", "raf", "rw2", "pef", "srw", "gpr")


class LibraryError(ValueError):
    pass


class NotFound(LibraryError):
    pass


def under(path: Column, folder: str) -> Column:
    """Whether a path is a folder or below it, by whole components."""
    clean = folder.rstrip("/") or "/"
    return (path == clean) | path.startswith(clean.rstrip("/") + "/")


def is_supported(extension: Column) -> Column:
    return F.lower(extension).isin(*PICTURES, *PANORAMAS, *STACKS)


def is_pano(extension: Column) -> Column:
    return F.lower(extension).isin(*PANORAMAS)


def is_stack(extension: Column) -> Column:
    return F.lower(extension).isin(*STACKS)


def discover_files(spark: SparkSession, folder: str, shallow: bool = False) -> DataFrame:
    """path, length of the pictures in a folder; hidden folders and double files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(not shallow).lower()).load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    dotted = F.substring_index(F.col("path"), folder.rstrip("/"), -1).rlike(r"/\.")
    return files.filter(is_supported(F.element_at(F.split(name, r"\."), -1)) & ~name.startswith("._") & ~dotted)


def list_subfolders(spark: SparkSession, folder: str) -> DataFrame:
    """path of the folders right below one that hold files, at any depth; dotted ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    below = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    name = F.substring_index(below, "/", 1)
    return files.filter(below.contains("/") & ~name.startswith(".")).select(F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("path")).distinct().orderBy("path")


def file_parts(path: str) -> tuple[str, str]:
    """A path's file name and its ending, lower case, as images hold them."""
    name = path.rstrip("/").rpartition("/")[2]
    stem, dot, ending = name.rpartition(".")
    return name, ending.lower() if dot and stem else ""


@dataclass(frozen=True)
class Filter:
    """What a listing shows; all given conditions hold together."""

    min_rating: int | None = None
    flag: str | None = None
    extension: str | None = None
    folder_id: int | None = None
    collection_id: int | None = None
    keyword: str | None = None
    include_hidden: bool = False
    name_like: str | None = None
    edited: bool | None = None
    taken: tuple[str, str] | None = None


def partial_span(text: str) -> tuple[str, str]:
    """A date given as year, year and month, or in full, as its first and last second in EXIF's form."""
    import calendar
    import re

    m = re.fullmatch(r"\s*(\d{4})(?:[-:/.](\d{1,2})(?:[-:/.](\d{1,2}))?)?\s*", text)
    if not m:
        raise LibraryError(f"not a date: {text!r}")
    y, mo, d = int(m[1]), m[2] and int(m[2]), m[3] and int(m[3])
    if mo is not None and not 1 <= mo <= 12:
        raise LibraryError(f"not a date: {text!r}")
    last = d or calendar.monthrange(y, mo or 12)[1]
    return f"{y:04}:{mo or 1:02}:{d or 1:02} 00:00:00", f"{y:04}:{mo or 12:02}:{last:02} 23:59:59"


@dataclass(frozen=True)
class Library:
    folders: DataFrame
    images: DataFrame
    collections: DataFrame
    members: DataFrame
    thumbnails: DataFrame
    exif: DataFrame
    keywords: DataFrame
    decoded_dims: DataFrame
    meta: DataFrame

    # -- opening and saving -------------------------------------------------
    @staticmethod
    def empty(spark: SparkSession, **tables: DataFrame) -> Library:
        """A library with the given tables; missing ones are empty and missing columns null or 0."""
        out = {}
        for name, schema in SCHEMAS.items():
            base = spark.createDataFrame([], schema)
            if name in tables:
                df = tables[name]
                zero = {"hidden", "trashed", "edited", "rating", "last_opened", "picked_at", "added_at"}
                out[name] = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(0 if f.name in zero else "none" if f.name == "flag" else None)).cast(f.dataType).alias(f.name) for f in base.schema])
            else:
                out[name] = base
        return Library(**out)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Library:
        """A saved library; one of another version is refused."""
        if pending := Library.pending_upgrade(spark, path):
            raise LibraryError(f"{path} has version {pending[0]}, not {VERSION}")
        lib = Library(**{name: spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}") for name, schema in SCHEMAS.items()})
        return replace(lib, meta=lib.meta.filter(F.col("key") != VERSION_KEY))

    def save(self, path: str, thumbnails: bool = True, mode: str = "errorifexists", go_on: Callable[[str], bool] | None = None) -> bool:
        """A snapshot of all tables, meta with the version last, so that a folder with it is whole; without thumbnails that table is written empty. go_on is asked before each table, and False ends the snapshot unfinished."""
        version = self.meta.sparkSession.createDataFrame([(VERSION_KEY, str(VERSION))], SCHEMAS["meta"])
        for name in sorted(SCHEMAS, key=lambda k: k == "meta"):
            if go_on and not go_on(name):
                return False
            df = getattr(self, name)
            df = df.filter(F.col("key") != VERSION_KEY).unionByName(version) if name == "meta" else df
            (df if thumbnails or name != "thumbnails" else df.limit(0)).write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")
        return True

    @staticmethod
    def saved_version(spark: SparkSession, path: str) -> int | None:
        """The version of a saved library; None for a folder without a whole one."""
        try:
            row = spark.read.schema(SCHEMAS["meta"]).parquet(f"{path.rstrip('/')}/meta").filter(F.col("key") == VERSION_KEY).first()
        except AnalysisException:
            return None
        return int(row.value) if row else None

    @staticmethod
    def is_unfinished(spark: SparkSession, path: str) -> bool:
        """Whether a snapshot was begun here and not ended."""
        return Library.saved_version(spark, path) is None

    @staticmethod
    def pending_upgrade(spark: SparkSession, path: str) -> tuple[int, int] | None:
        """(from, to) if a saved library is older than this version, None if it is this one; a newer one, or none, is an error."""
        found = Library.saved_version(spark, path)
        if found is None:
            raise LibraryError(f"{path} holds no library")
        if found > VERSION:
            raise LibraryError(f"{path} has version {found}, newer than {VERSION}")
        return (found, VERSION) if found < VERSION else None

    @staticmethod
    def snapshot_unopened(spark: SparkSession, path: str, to: str) -> None:
        """A copy of a saved library as it is, whatever its version, without opening it; the copy is whole when its meta is there."""
        for name in sorted(SCHEMAS, key=lambda k: k == "meta"):
            spark.read.schema(SCHEMAS[name]).parquet(f"{path.rstrip('/')}/{name}").write.parquet(f"{to.rstrip('/')}/{name}")

    def checkpoint(self) -> Library:
        """The same library with its tables written to the shared folder, so that plans of many updates don't pile up."""
        return Library(**{f.name: checkpointed(getattr(self, f.name)) for f in fields(self)})

    def batch(self, *steps: Callable[[Library], Library]) -> Library:
        """Updates one after another; if one fails none has taken place, since every library is a value."""
        return reduce(lambda lib, step: step(lib), steps, self)

    @staticmethod
    def counts_unopened(spark: SparkSession, path: str) -> DataFrame:
        """images, folders, collections of a saved library, from its files' footers."""
        one = lambda k: spark.read.schema(SCHEMAS[k]).parquet(f"{path.rstrip('/')}/{k}").agg(F.count(F.lit(1)).alias(k))
        return one("images").crossJoin(one("folders")).crossJoin(one("collections"))

    def recovery_inventory(self) -> DataFrame:
        """id, path, trashed of every image, in order of id."""
        return self.images.select("id", "path", (F.col("trashed") != 0).alias("trashed")).orderBy("id")

    @staticmethod
    def schema_version() -> int:
        return VERSION

    # -- listings -----------------------------------------------------------
    def list_images(self, f: Filter = Filter(), ordered: bool = True) -> DataFrame:
        """Images that aren't trashed; hidden ones only if asked for; those of hidden folders only if the folder is asked for."""
        df = self.images.filter("trashed = 0")
        if not f.include_hidden:
            df = df.filter("hidden = 0")
        if f.min_rating is not None:
            df = df.filter(F.col("rating") >= f.min_rating)
        if f.flag is not None:
            df = df.filter(F.col("flag") == f.flag)
        if f.extension is not None:
            df = df.filter(F.col("extension") == f.extension.lower())
        if f.edited is not None:
            df = df.filter((F.col("edited") != 0) == F.lit(f.edited))
        if f.name_like is not None:
            escaped = f.name_like.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
            df = df.filter(F.lower("file_name").like(escaped.lower()))
        if f.folder_id is not None:
            df = df.filter(F.col("folder_id") == f.folder_id)
        else:
            df = df.join(self.folders.filter("hidden = 1").select(F.col("id").alias("folder_id")), "folder_id", "left_anti")
        if f.collection_id is not None:
            df = df.join(self.members.filter(F.col("collection_id") == f.collection_id).select(F.col("image_id").alias("id")), "id", "left_semi")
        if f.keyword is not None:
            df = df.join(self.keywords.filter(F.lower("keyword") == f.keyword.strip().lower()).select(F.col("image_id").alias("id")), "id", "left_semi")
        if f.taken is not None:
            low, high = partial_span(f.taken[0])[0], partial_span(f.taken[1])[1]
            df = df.join(self.exif.filter(F.col("taken").between(low, high)).select(F.col("image_id").alias("id")), "id", "left_semi")
        df = df.select("id", "path", "file_name", "extension", "folder_id", "rating", "flag", "width", "height", "added_at", "edited", "link_group")
        return df.orderBy("file_name", "id") if ordered else df

    def list_trashed(self, folder_id: int | None = None) -> DataFrame:
        df = self.images.filter("trashed = 1")
        return (df if folder_id is None else df.filter(F.col("folder_id") == folder_id)).orderBy("folder_id", "file_name", "id")

    def image(self, image_id: str) -> DataFrame:
        return self.images.filter(F.col("id") == image_id)

    def image_id_taken(self, image_id: str) -> DataFrame:
        """taken: whether any image, trashed and hidden ones too, has an id."""
        return self.images.filter(F.col("id") == image_id).agg((F.count(F.lit(1)) > 0).alias("taken"))

    def is_trashed(self, image_id: str) -> DataFrame:
        return self.image(image_id).select("id", (F.col("trashed") != 0).alias("trashed"))

    def is_hidden(self, image_id: str) -> DataFrame:
        return self.image(image_id).select("id", (F.col("hidden") != 0).alias("hidden"))

    def hidden_ids_in_folder(self, folder_id: int) -> DataFrame:
        return self.images.filter((F.col("folder_id") == folder_id) & (F.col("hidden") == 1)).select("id")

    def decoded_dimensions(self, image_id: str, source_key: str) -> DataFrame:
        return self.decoded_dims.filter((F.col("image_id") == image_id) & (F.col("source_key") == source_key)).select("width", "height")

    def thumbnail(self, image_id: str) -> DataFrame:
        return self.thumbnails.filter(F.col("image_id") == image_id).select("kind", "data")

    def exif_of(self, image_id: str) -> DataFrame:
        """What was read from an image's headers, with the reader that read it."""
        return self.exif.filter(F.col("image_id") == image_id).drop("image_id")

    def meta_value(self, key: str) -> DataFrame:
        return self.meta.filter(F.col("key") == key).select("value")

    def image_id_by_path(self, path: str) -> DataFrame:
        return self.images.filter(F.col("path") == path).select("id")

    # -- folders ------------------------------------------------------------
    def list_folders(self) -> DataFrame:
        return self.folders.select("id", "path").orderBy("path")

    def folder_id(self, path: str) -> DataFrame:
        return self.folders.filter(F.col("path") == path).select("id")

    def folder_spelling_candidates(self, path: str) -> DataFrame:
        """path of folders that may be another spelling of one: the same but for case, or with the same last name, whatever its case."""
        name = path.rpartition("/")[2].lower()
        low = F.lower("path")
        return self.folders.filter((F.col("path") != path) & ((low == path.lower()) | low.endswith("/" + name) | low.endswith("\\" + name))).select("path")

    def hidden_folder_paths(self) -> DataFrame:
        return self.folders.filter("hidden = 1").select("path")

    def _counted(self) -> DataFrame:
        live = self.images.filter("trashed = 0").groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
        return self.folders.filter("hidden = 0").join(live, F.col("id") == F.col("folder_id"), "left").select("id", "path", "last_opened", "picked_at", F.coalesce("n", F.lit(0)).cast("bigint").alias("image_count"))

    def folder_summaries(self) -> DataFrame:
        return self._counted().select("id", "path", "last_opened", "image_count").orderBy(F.desc("last_opened"), "path")

    def recent_picked_folders(self, limit: int) -> DataFrame:
        return self._counted().filter("picked_at > 0").orderBy(F.desc("picked_at"), "path").limit(limit).select("id", "path", "last_opened", "image_count")

    def folder_scope(self, path: str, only: bool = False) -> DataFrame:
        return self.folders.filter(F.col("path") == path if only else under(F.col("path"), path)).select("id", "path")

    def scoped_images(self, path: str, only: bool = False) -> DataFrame:
        scope = self.folder_scope(path, only).select(F.col("id").alias("folder_id"))
        return self.images.join(scope, "folder_id", "left_semi").select("id", "path")

    def scoped_counts(self, path: str, only: bool = False, trashed: int = 0) -> DataFrame:
        """folders, images: how many of each are in scope."""
        scope = self.folder_scope(path, only)
        live = self.images.filter(F.col("trashed") == trashed).groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
        return scope.join(live, F.col("id") == F.col("folder_id"), "left").agg(F.count(F.lit(1)).alias("folders"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("images"))

    def _paths_of(self, condition: str) -> DataFrame:
        return self.folders.join(self.images.filter(condition).select(F.col("folder_id").alias("id")).distinct(), "id").select("path").distinct().orderBy("path")

    def edited_folder_paths(self) -> DataFrame:
        return self._paths_of("edited <> 0 and trashed = 0")

    def folders_with_hidden(self) -> DataFrame:
        return self._paths_of("hidden = 1 and trashed = 0")

    def folders_with_trash(self) -> DataFrame:
        return self._paths_of("trashed = 1")

    def count_in(self, path: str, condition: str) -> DataFrame:
        """n of a folder's images that meet a condition, as hidden = 1."""
        return self.images.filter(condition).join(self.folders.filter(F.col("path") == path).select(F.col("id").alias("folder_id")), "folder_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))

    # -- keywords, collections, figures --------------------------------------
    def keywords_of(self, image_id: str) -> DataFrame:
        return self.keywords.filter(F.col("image_id") == image_id).select("keyword").distinct().orderBy(F.lower("keyword"))

    def all_keywords(self) -> DataFrame:
        """Keywords without regard to case, each as it is first in order."""
        return self.keywords.groupBy(F.lower("keyword").alias("k")).agg(F.min("keyword").alias("keyword")).orderBy("k").select("keyword")

    def list_collections(self) -> DataFrame:
        return self.collections.orderBy("name")

    def collection_summaries(self) -> DataFrame:
        live = self.members.join(self.images.filter("trashed = 0").select(F.col("id").alias("image_id")), "image_id", "left_semi").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
        return self.collections.join(live, F.col("id") == F.col("collection_id"), "left").select("id", "name", "graph_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("image_count")).orderBy("name")

    def counts(self) -> DataFrame:
        """folders, images, collections."""
        return reduce(lambda a, b: a.crossJoin(b), [getattr(self, k).agg(F.count(F.lit(1)).alias(k)) for k in ("folders", "images", "collections")])

    def irreplaceable_bytes(self) -> DataFrame:
        """bytes: about what the tables hold besides thumbnails, which can be made again."""
        texts = [(getattr(self, f.name), [F.coalesce(F.octet_length(F.col(c.name).cast("string")), F.lit(0)) for c in getattr(self, f.name).schema]) for f in fields(self) if f.name != "thumbnails"]
        parts = [df.agg(F.coalesce(F.sum(sum(sizes, F.lit(0))), F.lit(0)).cast("bigint").alias("bytes")) for df, sizes in texts]
        return reduce(DataFrame.union, parts).agg(F.sum("bytes").alias("bytes"))

    def stats(self) -> DataFrame:
        """thumbnails and their bytes: one row of totals."""
        return self.thumbnails.agg(F.count(F.lit(1)).alias("thumbnails"), F.coalesce(F.sum(F.length("data")), F.lit(0)).cast("bigint").alias("thumbnail_bytes"))

    def exif_for_folder(self, folder_id: int) -> DataFrame:
        return self.exif.join(self.images.filter(F.col("folder_id") == folder_id).select(F.col("id").alias("image_id")), "image_id", "left_semi")

    def image_has_own_work(self) -> DataFrame:
        """id of images with a rating, a flag, an edit, a collection or a keyword."""
        own = self.images.filter("rating > 0 or flag <> 'none' or edited <> 0").select("id")
        n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: adaptive execution doesn't merge these, so a task's ids stay few
        # Ids made distinct a table at a time stand in for the tables' distinct rows, which then aren't built, and meet where they already lie.
        members, keywords = (df.select("image_id").distinct() for df in (self.members, self.keywords))
        return own.repartition(n, "id").union(members).union(keywords).distinct()

    def meta_keys(self, prefix: str) -> DataFrame:
        return self.meta.filter(F.col("key").startswith(prefix)).select("key").orderBy("key")

    # -- updates --------------------------------------------------------------
    def _set(self, ids: Sequence[str], **values) -> Library:
        """Columns of some images set; an id that isn't there is an error."""
        there = {r[0] for r in self.images.filter(F.col("id").isin(list(ids))).select("id").collect()}
        if missing := set(ids) - there:
            raise NotFound(f"no image {sorted(missing)[0]!r}")
        hit = F.col("id").isin(list(ids))
        types = {f.name: f.dataType for f in self.images.schema}
        return replace(self, images=self.images.withColumns({k: F.when(hit, F.lit(v).cast(types[k])).otherwise(F.col(k)) for k, v in values.items()}))

    def set_rating(self, image_id: str, rating: int) -> Library:
        if not 0 <= rating <= 5:
            raise LibraryError("a rating is 0 to 5")
        return self._set([image_id], rating=rating)

    def set_flag(self, image_id: str, flag: str) -> Library:
        if flag not in FLAGS:
            raise LibraryError(f"no flag {flag!r}")
        return self._set([image_id], flag=flag)

    def set_edited(self, image_id: str, edited: bool = True) -> Library:
        return self._set([image_id], edited=int(edited))

    def set_hidden(self, image_id: str, hidden: bool) -> Library:
        return self._set([image_id], hidden=int(hidden))

    def set_trashed(self, image_id: str, trashed: bool) -> Library:
        return self._set([image_id], trashed=int(trashed))

    def set_dimensions(self, image_id: str, width: int, height: int) -> Library:
        return self._set([image_id], width=width, height=height)

    def set_link_group(self, ids: Sequence[str], group: str | None) -> Library:
        return self._set(ids, link_group=group)

    def assign_folder_if_elsewhere(self, image_id: str, folder_id: int) -> tuple[Library, bool]:
        """An image in a folder, and whether it was elsewhere."""
        away = not self.images.filter((F.col("id") == image_id) & ~F.col("folder_id").eqNullSafe(F.lit(folder_id))).isEmpty()
        return (self.assign_folder(image_id, folder_id) if away else self), away

    def add_image(self, image_id: str, path: str, folder_id: int | None, now: int) -> Library:
        """An image added with its name and ending from its path; an id or a path that is there is an error."""
        if not self.images.filter((F.col("id") == image_id) | (F.col("path") == path)).isEmpty():
            raise LibraryError(f"there is an image {image_id!r} or {path!r} already")
        name, ending = file_parts(path)
        row = self.images.sparkSession.createDataFrame([(image_id, path, name, ending, folder_id, 0, "none", None, None, now, 0, 0, 0, None)], SCHEMAS["images"])
        return replace(self, images=self.images.unionByName(row.select(*self.images.columns)))

    def set_image_path(self, image_id: str, path: str, folder_id: int | None = None) -> Library:
        """An image at another path, with its name and ending from it, and in another folder if one is given."""
        name, ending = file_parts(path)
        return self._set([image_id], path=path, file_name=name, extension=ending, **({} if folder_id is None else {"folder_id": folder_id}))

    def assign_folder(self, image_id: str, folder_id: int) -> Library:
        return self._set([image_id], folder_id=folder_id)

    def _folder_update(self, condition: Column, **values: Column) -> Library:
        return replace(self, folders=self.folders.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()}))

    def hide_folder(self, path: str) -> Library:
        return self._folder_update(F.col("path") == path, hidden=F.lit(1))

    def touch_folder(self, folder_id: int, now: int) -> Library:
        return self._folder_update(F.col("id") == folder_id, last_opened=F.lit(now))

    def pick_folder(self, folder_id: int, now: int) -> Library:
        return self._folder_update(F.col("id") == folder_id, picked_at=F.lit(now))

    def recover_hidden(self, path: str) -> Library:
        ids = self.folders.filter(F.col("path") == path).select(F.col("id").alias("folder_id"), F.lit(1).alias("_hit"))
        df = self.images.join(ids, "folder_id", "left").withColumn("hidden", F.when(F.col("_hit").isNotNull(), F.lit(0)).otherwise(F.col("hidden")))
        return replace(self, images=df.select(*self.images.columns))

    def rename_folder_paths(self, old: str, new: str) -> Library:
        """A folder moved, with all below it and their images."""
        at = len(old.rstrip("/")) + 1

        def moved(df: DataFrame) -> DataFrame:
            return df.withColumn("path", F.when(under(F.col("path"), old), F.concat(F.lit(new.rstrip("/")), F.expr(f"substring(path, {at})"))).otherwise(F.col("path")))

        return replace(self, folders=moved(self.folders), images=moved(self.images))

    def add_folder(self, path: str) -> Library:
        """A folder added if it isn't there; one that is, is shown again."""
        spark = self.folders.sparkSession
        top = self.folders.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        row = spark.createDataFrame([(path,)], "path string").join(self.folders.select("path"), "path", "left_anti").crossJoin(top)
        new = row.select((F.col("top") + 1).alias("id"), "path", F.lit(0).cast("bigint").alias("last_opened"), F.lit(0).cast("bigint").alias("picked_at"), F.lit(0).alias("hidden"))
        shown = self._folder_update(F.col("path") == path, hidden=F.lit(0))
        return replace(shown, folders=shown.folders.unionByName(new))

    def forget_images(self, ids: DataFrame) -> Library:
        """Images (rows with id) gone with all that depends on them."""
        gone = ids.select("id").distinct()
        out = {"images": self.images.join(gone, "id", "left_anti").select(*self.images.columns)}
        for name in DEPENDENT:
            df = getattr(self, name)
            out[name] = df.join(gone.select(F.col("id").alias("image_id")), "image_id", "left_anti").select(*df.columns)
        return replace(self, **out)

    def flush_folder(self, path: str, only: bool = False) -> Library:
        """Folders in scope gone with their images."""
        scope = self.folder_scope(path, only).select(F.col("id").alias("folder_id"))
        lib = self.forget_images(self.images.join(scope, "folder_id", "left_semi").select("id"))
        return replace(lib, folders=lib.folders.join(scope.select(F.col("folder_id").alias("id")), "id", "left_anti").select(*self.folders.columns))

    def set_keywords(self, image_id: str, words: Sequence[str]) -> Library:
        """An image's keywords replaced: trimmed, none empty, each once whatever its case."""
        clean: dict[str, str] = {}
        for w in words:
            if w.strip():
                clean.setdefault(w.strip().lower(), w.strip())
        new = self.keywords.sparkSession.createDataFrame([(image_id, w) for w in clean.values()], SCHEMAS["keywords"])
        return replace(self, keywords=self.keywords.filter(F.col("image_id") != image_id).unionByName(new))

    def create_collection(self, name: str) -> Library:
        clean = name.strip()
        if not clean or not self.collections.filter(F.lower("name") == clean.lower()).isEmpty():
            raise LibraryError(f"there is a collection named {clean!r} already" if clean else "a collection needs a name")
        top = self.collections.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
        return replace(self, collections=self.collections.unionByName(top.select((F.col("top") + 1).alias("id"), F.lit(clean).alias("name"), F.lit(None).cast("string").alias("graph_id"))))

    def _collection(self, collection_id: int) -> Library:
        if self.collections.filter(F.col("id") == collection_id).isEmpty():
            raise NotFound(f"no collection {collection_id}")
        return self

    def rename_collection(self, collection_id: int, name: str) -> Library:
        if not self._collection(collection_id).collections.filter((F.lower("name") == name.lower()) & (F.col("id") != collection_id)).isEmpty():
            raise LibraryError(f"there is a collection named {name!r} already")
        return replace(self, collections=self.collections.withColumn("name", F.when(F.col("id") == collection_id, F.lit(name)).otherwise(F.col("name"))))

    def set_collection_graph(self, collection_id: int, graph_id: str | None) -> Library:
        hit = F.col("id") == collection_id
        return replace(self._collection(collection_id), collections=self.collections.withColumn("graph_id", F.when(hit, F.lit(graph_id).cast("string")).otherwise(F.col("graph_id"))))

    def restore_collection(self, collection_id: int, name: str, graph_id: str | None, members: DataFrame) -> Library:
        """A deleted collection back with the members (image_id) it had that are still images, under its id if that is free."""
        if not self.collections.filter(F.lower("name") == name.lower()).isEmpty():
            raise LibraryError(f"there is a collection named {name!r} already")
        taken, top = self.collections.agg(F.max(F.when(F.col("id") == collection_id, 1)), F.coalesce(F.max("id"), F.lit(0))).first()
        back = top + 1 if taken else collection_id
        row = self.collections.sparkSession.createDataFrame([(back, name, graph_id)], SCHEMAS["collections"])
        there = members.select("image_id").distinct().join(self.images.select(F.col("id").alias("image_id")), "image_id", "left_semi")
        return replace(self, collections=self.collections.unionByName(row), members=self.members.unionByName(there.select(F.lit(back).cast("bigint").alias("collection_id"), "image_id")))

    def clear_thumbnail(self, image_id: str) -> Library:
        return replace(self, thumbnails=self.thumbnails.filter(F.col("image_id") != image_id))

    def clear_rendered_thumbnails(self) -> Library:
        """Thumbnails that were rendered gone; those that cameras embed stay."""
        return replace(self, thumbnails=self.thumbnails.filter(F.col("kind") != "rendered"))

    def clear_thumbnails(self) -> Library:
        return replace(self, thumbnails=self.thumbnails.limit(0))

    def delete_meta(self, key: str) -> Library:
        return replace(self, meta=self.meta.filter(F.col("key") != key))

    def add_to_collection(self, collection_id: int, image_id: str) -> Library:
        row = self.members.sparkSession.createDataFrame([(collection_id, image_id)], SCHEMAS["members"])
        return replace(self, members=self.members.unionByName(row.join(self.members, ["collection_id", "image_id"], "left_anti")))

    def remove_from_collection(self, collection_id: int, image_id: str) -> Library:
        return replace(self, members=self.members.filter(~((F.col("collection_id") == collection_id) & (F.col("image_id") == image_id))))

    def delete_collection(self, collection_id: int) -> tuple[Library, DataFrame]:
        """The library without a collection, and the members it had."""
        had = self.members.filter(F.col("collection_id") == collection_id).orderBy("image_id")
        return replace(self, collections=self.collections.filter(F.col("id") != collection_id), members=self.members.filter(F.col("collection_id") != collection_id)), had

    def upsert(self, name: str, rows: DataFrame, key: Sequence[str]) -> Library:
        """Rows put into a table, later ones in place of those with their key."""
        old = getattr(self, name)
        return replace(self, **{name: old.join(rows.select(*key).distinct(), list(key), "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))})

    def absorb_image(self, keeper: str, newcomer: str) -> Library:
        """One image's dependents handed to another, once each, and the image gone."""
        out = {}
        for name in ("members", "keywords"):
            df = getattr(self, name)
            out[name] = df.withColumn("image_id", F.when(F.col("image_id") == newcomer, F.lit(keeper)).otherwise(F.col("image_id"))).distinct()
        lib = replace(self, **out)
        return lib.forget_images(lib.images.filter(F.col("id") == newcomer))

    # -- import ---------------------------------------------------------------
    def import_from(self, other: Library) -> Library:
        """All of another library that isn't here: folders and images by path, collections by name; what is here wins. Ids of folders, images and collections are carried over to the ones here; keywords and members come together without doubles."""
        top = {k: getattr(self, k).agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("top")) for k in ("folders", "collections")}

        def carried(name: str, key: str):
            mine, theirs = getattr(self, name), getattr(other, name)
            fresh = theirs.join(mine.select(key), key, "left_anti").dropDuplicates([key])
            # fresh ids follow on from the largest here, in the order of the natural key
            ordered = numbered(fresh, key, name="_n").crossJoin(top[name])
            added = ordered.withColumn("id", F.col("top") + F.col("_n")).select(*mine.columns)
            merged = mine.unionByName(added)
            ids = theirs.select(F.col("id").alias("old"), key).join(merged.select(F.col("id").alias("new"), key), key).select("old", "new")
            return merged, ids

        folders, folder_ids = carried("folders", "path")
        collections, collection_ids = carried("collections", "name")
        fresh = other.images.join(self.images.select("path"), "path", "left_anti").join(self.images.select("id"), "id", "left_anti")
        placed = fresh.join(folder_ids, F.col("folder_id") == F.col("old"), "left").withColumn("folder_id", F.col("new")).select(*self.images.columns)
        images = self.images.unionByName(placed)
        image_ids = other.images.select(F.col("id").alias("old"), "path").join(images.select(F.col("id").alias("new"), "path"), "path").select("old", "new")

        def rekeyed(name: str) -> DataFrame:
            df = getattr(other, name)
            return df.join(image_ids, F.col("image_id") == F.col("old")).withColumn("image_id", F.col("new")).select(*df.columns)

        words = self.keywords.unionByName(rekeyed("keywords")).groupBy("image_id", F.lower("keyword").alias("k")).agg(F.min("keyword").alias("keyword")).select("image_id", "keyword")
        members = rekeyed("members").join(collection_ids, F.col("collection_id") == F.col("old")).select(F.col("new").alias("collection_id"), "image_id")
        out = {"folders": folders, "collections": collections, "images": images, "keywords": words, "members": self.members.unionByName(members).distinct()}
        for name, key in (("thumbnails", ["image_id"]), ("exif", ["image_id"]), ("decoded_dims", ["image_id", "source_key"])):
            mine = getattr(self, name)
            out[name] = mine.unionByName(rekeyed(name).join(mine.select(*key), key, "left_anti").select(*mine.columns))
        out["meta"] = self.meta.unionByName(other.meta.join(self.meta.select("key"), "key", "left_anti").select(*self.meta.columns))
        return replace(self, **out)


def shutter_seconds(text: Column) -> Column:
    """A shutter speed as 1/250 or 0.5 in seconds."""
    part = F.split(text, "/")
    return F.when(text.contains("/"), F.try_divide(F.element_at(part, 1).try_cast("double"), F.try_element_at(part, F.lit(2)).try_cast("double"))).otherwise(text.try_cast("double"))


def table_sort(df: DataFrame, key: Column, name: str = "file_name", descending: bool = False) -> DataFrame:
    """Rows by a key with blanks last in both directions, ties by name."""
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(name).asc())


def export_names(images: DataFrame, template: str, total: int | None = None) -> DataFrame:
    """images with n and export_name: {name} {n} {stars} {flag} filled in, in listing order, and names that fold to the same told apart by -2, -3, ..."""
    count = total if total is not None else images.count()
    width = len(str(max(1, count)))
    rows = numbered(images, "file_name", "id")
    name = F.lit(template)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    for tag, value in (("{name}", stem), ("{n}", F.lpad(F.col("n").cast("string"), width, "0")), ("{stars}", F.col("rating").cast("string")), ("{flag}", F.col("flag"))):
        name = F.replace(name, F.lit(tag), value)
    rows = rows.withColumn("_base", name)
    # few names may take most images: they are numbered in order of the name, whatever task they are in, less the number before their first
    ranked = numbered(rows, F.lower("_base"), "n", name="_k")
    first = ranked.groupBy(F.lower("_base").alias("_low")).agg(F.min("_k").alias("_first"))
    ranked = ranked.join(first, F.lower("_base") == F.col("_low")).withColumn("_k", F.col("_k") - F.col("_first") + 1)
    return ranked.withColumn("export_name", F.when(F.col("_k") > 1, F.concat("_base", F.lit("-"), F.col("_k").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_k", "_low", "_first")
