"""Sources: images, OCR documents, label files, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OCR_SCHEMA, label_table

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
SPLIT_NAMES = {"val": "valid"}


def has_extension(path, extensions: tuple[str, ...] = EXTENSIONS):
    return F.lower(path).rlike(r"\.(" + "|".join(extensions) + r")$")


def with_path_parts(files: DataFrame, root: str = "") -> DataFrame:
    """Add split, class_name (empty if the folder is no number), file_name and stem, from the last folders of path."""
    parts = F.split("path", "/")
    split = F.regexp_extract("path", r"/(train|valid|val|test)/", 1)
    return files.withColumns({
        "split": F.when(split == "val", "valid").otherwise(split),
        "class_name": F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1),
        "file_name": F.element_at(parts, -1),
        "stem": F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", ""),
    })


def list_images(spark: SparkSession, folder: str, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS, mixed_case: bool = True) -> DataFrame:
    """Paths of image files with size and time, by path; the files are not read.

    Without mixed_case only suffixes all in small or all in capital letters count.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    fits = has_extension(F.col("path"), extensions)
    if not mixed_case:
        suffix = F.regexp_extract("path", r"\.([^.]+)$", 1)
        fits = fits & ((suffix == F.lower(suffix)) | (suffix == F.upper(suffix)))
    return with_path_parts(files.where(fits)).orderBy("path")


def read_images(spark: SparkSession, folder: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded images: path, ok, height, width, channels, data (BGR), and the parts of the path. Unreadable ones have ok = false."""
    raw = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).option("recursiveFileLookup", "true").load(folder)
    flat = raw.select(F.col("image.origin").alias("path"), (F.col("image.height") > 0).alias("ok"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return with_path_parts(flat)


def in_splits(files: DataFrame, splits: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Rows of the wanted splits, and the wanted splits that have none."""
    wanted = files.where(F.col("split").isin([SPLIT_NAMES.get(s, s) for s in splits]))
    found = {r["split"] for r in wanted.select("split").distinct().collect()}
    return wanted, [s for s in splits if SPLIT_NAMES.get(s, s) not in found]


def checked_classes(files: DataFrame, classes: tuple[str, ...] = ("0", "90", "180", "270")) -> DataFrame:
    """Files whose class is expected, with it as a number; raises on any other class."""
    odd = [r[0] for r in files.where(~F.col("class_name").isin(list(classes))).select("class_name").distinct().limit(5).collect()]
    if odd:
        raise ValueError(f"unexpected classes: {odd}")
    return files.withColumn("angle", F.col("class_name").cast("int"))


def class_index(files: DataFrame) -> DataFrame:
    """(class_name, class_idx) in the order of the names as strings: 0, 180, 270, 90."""
    names = sorted(r[0] for r in files.select("class_name").distinct().collect())
    return files.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "class_name string, class_idx int")


def require_equal_classes(files: DataFrame, a: str = "train", b: str = "valid") -> None:
    """Raises where one split has a class that the other has not: their class numbers would not mean the same."""
    seen = files.where(F.col("split").isin(a, b)).groupBy("class_name").agg(F.count_distinct("split").alias("n")).where("n < 2").orderBy("class_name")
    if odd := [r["class_name"] for r in seen.limit(5).collect()]:
        raise ValueError(f"classes in only one of {a} and {b}: {odd}")


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """OCR documents, one JSON object per file, with path, stem and whether they are valid."""
    rows = spark.read.schema(OCR_SCHEMA).option("multiLine", "true").json(path).withColumn("path", F.input_file_name())
    valid = F.col("tokens").isNotNull() & F.col("bboxes").isNotNull() & (F.size("tokens") == F.size("bboxes"))
    return with_path_parts(rows).withColumn("valid", F.coalesce(valid, F.lit(False)))


def ocr_tokens(docs: DataFrame) -> DataFrame:
    """Words of valid OCR documents with corners and thousandths, the stored ones where there are some."""
    from ..functions.geometry import clamp_box, normalize_box
    from ..functions.text import strip_text

    zipped = F.arrays_zip("tokens", "bboxes", "bboxes_norm")
    flat = docs.where("valid").withColumn("bboxes_norm", F.coalesce("bboxes_norm", F.array().cast("array<array<bigint>>"))).select(F.col("stem").alias("image_id"), "size", F.posexplode(zipped).alias("box_idx", "z"))
    corners = [F.element_at("z.bboxes", k + 1) for k in range(4)]
    given = flat.select("image_id", "box_idx", strip_text(F.col("z.tokens")).alias("text"), *(c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"))), clamp_box(F.col("z.bboxes_norm")).alias("stored"), "size")
    computed = normalize_box(("x1", "y1", "x2", "y2"), F.col("size.width"), F.col("size.height"))
    return given.select("image_id", "box_idx", "text", "x1", "y1", "x2", "y2", *(F.coalesce(F.element_at("stored", k + 1), c).alias(n) for k, (n, c) in enumerate(computed.items())))


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """Label lines with at least five fields: stem, cls, xc, yc, w, h. A missing file gives no rows."""
    lines = with_path_parts(spark.read.text(path).withColumn("path", F.input_file_name()))
    fields = lines.select("stem", F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 5)
    return fields.select("stem", F.col("f")[0].cast("int").alias("cls"), *(F.col("f")[i].cast("double").alias(n) for i, n in enumerate(("xc", "yc", "w", "h"), 1)))


def yolo_boxes(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixel boxes of label lines joined with (stem, width, height); boxes without area are dropped."""
    from ..functions.geometry import yolo_pixels

    joined = labels.join(sizes, "stem")
    px = yolo_pixels(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return joined.select("stem", "cls", *(v.alias(k) for k, v in px.items())).where("x2 > x1 AND y2 > y1")


def pair_by_stem(images: DataFrame, sidecars: DataFrame, how: str = "left") -> DataFrame:
    return images.join(sidecars, "stem", how)


def label_dimension(spark: SparkSession, configured: dict[int, str] | None = None, numeric_ok: bool = False) -> DataFrame:
    """The model's own labels if it has any that are names (numbers count only with numeric_ok), else the fixed ones."""
    names = configured or {}
    if names and (numeric_ok or not all(str(v).isdigit() or str(v).startswith("LABEL_") for v in names.values())):
        return label_table(spark, tuple(names[k] for k in sorted(names)))
    return label_table(spark)


def pick_target(files: DataFrame, path: str | None = None, seed: int = 0) -> DataFrame:
    """The named file, or one at random but the same for a seed."""
    return files.where(F.col("path") == path) if path else files.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(1)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
