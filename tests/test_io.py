import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import imaging as im
from foliospark.operators import curation as cu
from foliospark.operators import evaluation as ev
from foliospark.operators import routing as ro
from foliospark.operators.scoring import StandIn, augmented_images, cropped, detect_boxes, image_records, loaded, mask_visuals, normalize_images, read_texts, tag_words
from foliospark.plans.extraction import Settings, extract
from foliospark.sources import files, readers, writers
from foliospark.streaming import ingest


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels[..., ::-1])
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def receipt():
    page = np.zeros((90, 70, 3), np.uint8)
    page[10:80, 10:60] = 230
    for y in range(18, 76, 12):
        page[y : y + 4, 15:50] = 20
    return page


def test_images_end_to_end(spark, tmp_path):
    folder = tmp_path / "train" / "90"
    folder.mkdir(parents=True)
    png(folder / "a.png", receipt())
    png(folder / "b.Png", receipt())
    (folder / "bad.png").write_bytes(b"no image")
    (folder / "note.txt").write_text("x")
    listed = readers.list_images(spark, str(tmp_path))
    assert [r.file_name for r in listed.collect()] == ["a.png", "b.Png", "bad.png"] and listed.first().split == "train"
    assert readers.list_images(spark, str(tmp_path), mixed_case=False).count() == 2
    images = readers.read_images(spark, str(tmp_path)).withColumn("image_id", F.col("file_name"))
    out = extract(images.where("file_name <> 'note.txt'"), StandIn())
    status = {r.image_id: r.status for r in out["normalized"].select("image_id", "status").collect()}
    assert status["a.png"] == "ok" and status["bad.png"] == "error"
    assert out["boxes"].where("image_id = 'a.png'").count() >= 1
    assert out["texts"].count() == out["boxes"].count()
    assert out["extracted"].columns == ["image_id", "entities", "texts", "joined"]


def halting(folder):
    """A scorer that notes each call of a model and cannot read while there is a file named halt."""

    class Halting(StandIn):
        def segment(self, images):
            with open(f"{self.folder}/segmented", "a") as f:
                f.write("x")
            return super().segment(images)

        def read(self, crops):
            if __import__("os").path.exists(f"{self.folder}/halt"):
                raise RuntimeError("halted")
            return super().read(crops)

    out = Halting()
    out.folder = str(folder)
    return out


def test_stages_resume_from_stored_tables(spark, tmp_path):
    page = receipt()
    rows = [(name, True, 90, 70, 3, bytes(page.tobytes())) for name in "ab"]
    images = spark.createDataFrame(rows, "image_id string, ok boolean, height int, width int, channels int, data binary").coalesce(1)
    scorer, at = halting(tmp_path), f"file://{tmp_path}/stages"
    (tmp_path / "halt").touch()
    with pytest.raises(Exception, match="halted"):
        extract(images, scorer, at=at)
    calls = (tmp_path / "segmented").read_text()
    (tmp_path / "halt").unlink()
    out = extract(images, scorer, at=at)
    assert (tmp_path / "segmented").read_text() == calls
    want = extract(images, StandIn())
    for name in ("texts", "tagged", "extracted"):
        assert sorted(map(str, out[name].collect())) == sorted(map(str, want[name].collect()))
    extract(images, scorer, Settings(on_missing="error"), at=at)  # other settings are other tables
    assert len((tmp_path / "segmented").read_text()) > len(calls)


def test_model_stages_carry_their_resources(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    images = spark.createDataFrame([], "image_id string, ok boolean, height int, width int, channels int, data binary")
    plan = lambda df: df._jdf.queryExecution().logical().numberedTreeString()
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(3)).build
    normalized = normalize_images(images, StandIn(), profile=profile)
    boxes = spark.createDataFrame([], "image_id string, box_idx int, x1 double, y1 double, x2 double, y2 double")
    words = spark.createDataFrame([], "image_id string, word_id int, text string, nx1 int, ny1 int, nx2 int, ny2 int")
    for df in (normalized, detect_boxes(normalized, StandIn(), profile=profile), read_texts(normalized, boxes, StandIn(), profile), tag_words(words, StandIn(), profile)):
        assert "cpus, amount: 3.0" in plan(df).splitlines()[0]
    assert "cpus" not in plan(normalize_images(images, StandIn()))


def moody(masks):
    """A scorer with settings of its own that fails on dark images. Made here, so that workers need not import this module."""

    class Moody(StandIn):
        def segment(self, images):
            if any(x.max() < 50 for x in images):
                raise RuntimeError("too dark")
            return [self.masks for _ in images]

    out = Moody()
    out.masks = masks
    return out


def test_causes_and_batches(spark):
    full, empty = np.ones((90, 70), bool), np.zeros((90, 70), bool)
    page, dark = receipt(), np.full((90, 70, 3), 9, np.uint8)
    rows = [(name, ok, 90, 70, 3, bytes(x.tobytes())) for name, ok, x in (("a", True, page), ("b", False, page), ("c", True, dark), ("d", True, page))]
    df = spark.createDataFrame(rows, "image_id string, ok boolean, height int, width int, channels int, data binary").coalesce(1)
    for masks, want in (([(0.9, full)], ("ok", None)), ([(0.9, empty)], ("error", "empty mask")), ([(0.1, full)], ("error", "no mask"))):
        got = {r.image_id: (r.status, r.error) for r in normalize_images(df, moody(masks), "error").collect()}
        assert got == {"a": want, "b": ("error", "unreadable"), "c": ("error", "too dark"), "d": want}
    with pytest.raises(ValueError, match="empty mask"):
        cropped(page, [(0.9, np.zeros((0, 0), bool))], 0.5, "error")


def test_scorers_of_one_class_are_told_apart():
    a, b, c = StandIn(), StandIn(), StandIn()
    a.weights, b.weights, c.weights = 1, 2, 1
    assert loaded(a).weights == 1 and loaded(b).weights == 2 and loaded(c) is loaded(a)


def test_records_of_images(spark, tmp_path):
    for split, angle, turn in (("train", "0", 0), ("train", "90", 90), ("valid", "0", 0), ("test", "0", 0)):
        (tmp_path / split / angle).mkdir(parents=True)
        png(tmp_path / split / angle / "x.png", im.rotate_label(receipt(), turn))
    png(tmp_path / "test" / "0" / "y.png", im.enhance(receipt())[..., None].repeat(3, axis=2)[:, ::-1])
    images = readers.read_images(spark, str(tmp_path))
    records = {(r.split_name, r.class_name, r.record_id): r for r in image_records(images, fail_on_error=True).collect()}
    first = records["train", "0", "train_0_000000"]
    assert len(records) == 5 and first.ok and first.angle == 0 and first.canonical_hash_hex == f"{first.canonical_hash_int:016x}"
    assert records["train", "90", "train_90_000000"].canonical_hash_int == first.canonical_hash_int
    groups = {r.path.rsplit("/", 3)[-3]: r.document_group_id for r in cu.document_groups(image_records(images)).where("record_id LIKE '%000000'").collect()}
    assert len(set(groups.values())) == 1
    (tmp_path / "test" / "0" / "bad.png").write_bytes(b"no image")
    with pytest.raises(ValueError, match="bad.png"):
        image_records(readers.read_images(spark, str(tmp_path)), fail_on_error=True)


def test_files_of_masks_and_of_turned_images(spark, tmp_path):
    page = receipt()
    rows = [(name, f"/p/{name}", ok, 90, 70, 3, page.tobytes()) for name, ok in (("a", True), ("b", False))]
    df = spark.createDataFrame(rows, "image_id string, path string, ok boolean, height int, width int, channels int, data binary")
    made = mask_visuals(df, StandIn()).first()
    picks = spark.createDataFrame([("90", "0", "r", 90, "/p/a")], "target_class string, source_class string, record_id string, rotation_applied long, path string")
    turned = augmented_images(picks, df).first()
    for name, data in (("mask", made.mask), ("visual", made.visual), ("turned", turned.png)):
        (tmp_path / f"{name}.png").write_bytes(data)
    read = {r.stem: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert (read["turned"] == im.rotate_label(page, 90)).all() and set(np.unique(read["mask"])) == {0, 255} and (read["visual"] == (0, 255, 0)).all(axis=2).any()
    assert mask_visuals(df, moody([])).first().status == "no mask"


def test_listings_and_dimensions(spark, tmp_path):
    for split, angle in (("train", "0"), ("train", "90"), ("val", "0"), ("val", "90")):
        (tmp_path / split / angle).mkdir(parents=True)
        png(tmp_path / split / angle / "x.png", receipt())
    files = readers.list_images(spark, str(tmp_path))
    wanted, missing = readers.in_splits(files, ("train", "val", "test"))
    assert wanted.count() == 4 and missing == ["test"]
    assert {r.angle for r in readers.checked_classes(files).collect()} == {0, 90}
    with pytest.raises(ValueError, match="90"):
        readers.checked_classes(files, ("0",))
    index = {s: readers.class_index(files.where(F.col("split") == s)).collect() for s in ("train", "valid")}
    assert index["train"] == index["valid"] == [("0", 0), ("90", 1)]
    readers.require_equal_classes(files, "train", "valid")
    with pytest.raises(ValueError, match="90"):
        readers.require_equal_classes(files.where("NOT (split = 'valid' AND class_name = '90')"), "train", "valid")
    assert readers.pick_target(files, seed=3).first() == readers.pick_target(files.repartition(3), seed=3).first()
    assert readers.pick_target(files, files.first().path).count() == 1
    assert readers.pair_by_stem(files, spark.createDataFrame([("x", 1)], "stem string, n int")).where("n = 1").count() == 4
    assert [r.label for r in readers.label_dimension(spark, {0: "A", 1: "B_PREFIX"}).collect()] == ["A", "B_PREFIX"]
    assert readers.label_dimension(spark, {0: "LABEL_0"}).count() == 37 and readers.label_dimension(spark, {0: "7"}, numeric_ok=True).count() == 1
    assert im.display_size(300, 400, 100) == (75, 100)


def test_deskew_log_and_parameters(spark):
    rows = spark.createDataFrame([("b", "ok", 1.239, -0.501, 2.00004, None), ("a", "error", None, None, None, "no mask")], "image_id string, status string, coarse_angle double, refined_angle double, best_score double, error string")
    assert [tuple(r) for r in ro.deskew_log(rows).collect()] == [("a", "error", None, None, None, "no mask"), ("b", "ok", 1.24, -0.5, 2.0, None)]
    assert tuple(ev.parameter_totals(spark.createDataFrame([(3, True), (4, False)], "numel long, trainable boolean")).first()) == (7, 3)


def test_ocr_documents(spark, tmp_path):
    doc = {"image": "a.jpg", "size": {"width": 473, "height": 602}, "bboxes": [[125, 102, 336, 122], [75, 125, 374, 141]], "bboxes_norm": [[264, 169, 710, 202], [158, 207, 790, 1234]], "class_ids": [0, 0], "tokens": [" x ", "y"]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    del doc["bboxes_norm"]
    (tmp_path / "b.json").write_text(json.dumps(doc))
    (tmp_path / "c.json").write_text(json.dumps(doc | {"tokens": ["one"]}))
    docs = readers.read_ocr(spark, str(tmp_path))
    assert {r.stem: r.valid for r in docs.collect()} == {"a": True, "b": True, "c": False}
    rows = {(r.image_id, r.box_idx): r for r in readers.ocr_tokens(docs).collect()}
    assert rows["a", 0].text == "x" and rows["a", 1].ny2 == 1000 and rows["b", 1].ny2 == 234


def test_yolo_labels(spark, tmp_path):
    boxes = spark.createDataFrame([("a", 10.0, 20.0, 30.0, 60.0, 0, 100, 200), ("a", 0.0, 0.0, 0.0, 9.0, 1, 100, 200)], "image_id string, x1 double, y1 double, x2 double, y2 double, cls_id int, width int, height int")
    writers.write_yolo(boxes, str(tmp_path / "labels"))
    (tmp_path / "more.txt").write_text("0 0.5 0.5\n")
    labels = readers.read_yolo(spark, str(tmp_path / "labels" / "image_id=a"))
    sizes = labels.select("stem").distinct().withColumns({"width": F.lit(100), "height": F.lit(200)})
    got = readers.yolo_boxes(labels, sizes).collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in got] == [(10, 20, 30, 60)]
    assert readers.read_yolo(spark, str(tmp_path / "more.txt")).count() == 0


def test_logs_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("é", "accepted"), ("b", "review")], "name string, status string")
    writers.write_csv_log(df, str(tmp_path / "log"), "name")
    assert readers.read_log(spark, str(tmp_path / "log")).count() == 2
    writers.write_routed(df, str(tmp_path / "routed"))
    assert spark.read.parquet(str(tmp_path / "routed" / "status=review")).count() == 1
    writers.write_json(df, str(tmp_path / "json"))
    assert any("é" in p.read_text() for p in (tmp_path / "json").glob("*.json"))
    assert r"a\_b & 1 \\" in writers.latex_table([("a_b", 1)], ("n", "v"))


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    doc = {"image": "a.jpg", "size": {"width": 10, "height": 10}, "bboxes": [[1, 2, 3, 4]], "class_ids": [0], "tokens": ["x"]}
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc))
    seen = []
    q = ingest.run_batches(ingest.stream_ocr(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r.stem for r in df.where("valid").collect()), str(tmp_path / "mark"))
    q.awaitTermination(60)
    assert seen == ["a"]


def test_scratch_nested_and_threaded(spark):
    from concurrent.futures import ThreadPoolExecutor

    from foliospark.storage import _located, scratch, store

    there = lambda t: (lambda files, at: files.exists(at))(*_located(spark, t.stored_at))
    with scratch(spark):
        with scratch(spark):
            pass
        outer = store(spark.range(3), "outer")
        with scratch(spark):
            inner = store(spark.range(2), "inner")
        assert there(outer) and not there(inner)
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(store, spark.range(1), "other").result()
        assert there(outer)
    assert not there(outer) and there(other)


def test_named_files_as_a_whole_or_not_at_all(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"labels/{i % 7}/{i}.txt", f"{i}\n".encode()) for i in range(200)] + [("é ü.bin", None)], "name string, content binary").repartition(5)
    files.write_files(rows, at)
    assert len(files.list_files(at)) == 201 and (tmp_path / "out/labels/3/10.txt").read_bytes() == b"10\n" and (tmp_path / "out/é ü.bin").read_bytes() == b""
    with pytest.raises(Exception, match="already"):
        files.write_files(rows, at)
    for bad in ("../x", "/x", "a//b", ""):
        broken = rows.unionByName(spark.createDataFrame([(bad, b"x")], "name string, content binary"))
        with pytest.raises(Exception, match="not the name"):
            files.write_files(broken, at, overwrite=True)
        assert len(files.list_files(at)) == 201  # as before
    with pytest.raises(ValueError, match="only ones"):
        files.write_files(rows.unionByName(rows), at, overwrite=True)
    files.write_files(rows.limit(3), "file:" + at, overwrite=True)
    assert len(files.list_files("file://" + at)) == 3
    files.write_files(rows.limit(0), str(tmp_path / "none"))
    assert files.list_files(str(tmp_path / "none")) == []
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none", "out"]  # nothing staged is left


def test_failed_attempts_leave_nothing(spark, tmp_path):
    """An attempt that fails half way and is tried again: every file once, whole."""
    writer = files._Writer(str(tmp_path / "tree"), False)
    rows = [{"name": f"a/{i}.txt", "content": b"x" * i} for i in range(20)]

    def dies():
        yield from rows[:7]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    message = writer.write(iter(rows))
    assert (message.files, message.size) == (20, sum(range(20)))
    writer.commit([message])
    assert len(files.list_files(str(tmp_path / "tree"))) == 20 and [p.name for p in tmp_path.iterdir()] == ["tree"]
    lost = files._Writer(str(tmp_path / "tree2"), False)
    lost.write(iter(rows))
    lost.abort([None])
    assert [p.name for p in tmp_path.iterdir()] == ["tree"]


def test_published_names(spark, tmp_path):
    for name, split in (("a b.PNG", "train"), ("bad.png", "train"), ("c.png", "valid")):
        folder = tmp_path / "in" / split / "90"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"no image") if name == "bad.png" else png(folder / name, receipt())
    plain = F.regexp_replace(F.regexp_replace("path", "%20", " "), "^file:/+", "/")
    images = readers.read_images(spark, str(tmp_path / "in")).withColumn("path", plain)
    bytes_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in")).select("path", "content")
    records = images.where("ok").select(F.col("split").alias("split_name"), "class_name", "path").join(bytes_.withColumn("path", plain), "path")
    broken = files.failed_files(images, str(tmp_path / "in")).select("name", F.lit(b"no image").alias("content"))
    boxes = spark.createDataFrame([("c", 1, 0.0, 0.0, 10.0, 20.0, 3, 100, 100), ("c", 0, 50.0, 50.0, 60.0, 60.0, 0, 100, 100)], "image_id string, box_idx int, x1 double, y1 double, x2 double, y2 double, cls_id int, width int, height int")
    labels = files.label_files(boxes, spark.createDataFrame([("c",), ("empty",)], "image_id string"))
    tree = files.original_files(records).select("name", "content").unionByName(broken).unionByName(labels.withColumn("content", F.col("content").cast("binary")))
    files.write_files(tree, str(tmp_path / "out"))
    assert files.list_files(str(tmp_path / "out")) == ["errors/train/90/bad.png", "labels/c.txt", "labels/empty.txt", "train/90/orig_a_b_000000.png", "valid/90/orig_c_000000.png"]
    assert (tmp_path / "out/labels/c.txt").read_text() == "0 0.550000 0.550000 0.100000 0.100000\n3 0.050000 0.100000 0.100000 0.200000\n"
    assert (tmp_path / "out/train/90/orig_a_b_000000.png").read_bytes() == (tmp_path / "in/train/90/a b.PNG").read_bytes()
    picks = spark.createDataFrame([("0", "90", "doc_000012", "r", "/x/a b.jpg", 270)], "target_class string, source_class string, document_group_id string, record_id string, path string, rotation_applied int")
    assert files.augmented_files(picks).first().name == "train/0/aug_target_0_from_90_rot_270_doc_000012_a_b_000000.png"
