"""Pluggable model stages.

A scorer is any object with load() and a method per stage; load() runs once in
each Python worker. Every method takes the images (or texts) of a whole Arrow
batch, so that a model can fill its own batches. The scorers in this module are
deterministic stand-ins: they compute with simple image kernels so that the
stages can be tested, and their outputs say nothing about a real model's
accuracy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import imaging as im
from ..functions.scores import hash_hex
from ..functions.text import record_id
from ..schemas import DETECTOR_CONF, LABELS, SEGMENT_CONF
from ..storage import bound_batches
from .curation import number_rows

#: Rows of an Arrow batch: images are large.
IMAGE_BATCH = 32
_LOADED: dict[str, object] = {}


class Scorer(Protocol):
    """What the stages call: one result for each image, in order. A method may be missing where its stage is not used."""

    def load(self) -> None: ...
    def segment(self, images: list[np.ndarray]) -> list[list[tuple[float, np.ndarray]]]: ...
    def orientation(self, images: list[np.ndarray]) -> list[list[float]]: ...
    def detect(self, images: list[np.ndarray], min_conf: float) -> list[list[tuple[float, float, float, float, float, int]]]: ...
    def read(self, crops: list[np.ndarray]) -> list[tuple[str, float]]: ...
    def tag(self, pages: list[tuple[list[str], list[tuple[int, int, int, int]]]]) -> list[list[tuple[int | None, list[float]]]]: ...


class StandIn:
    """Deterministic stand-in for every stage."""

    def load(self) -> None:
        pass

    def segment(self, images: list[np.ndarray]) -> list[list[tuple[float, np.ndarray]]]:
        return [[] if (mask := im.largest_region(plain > im.otsu(plain))) is None else [(0.9, mask)] for plain in map(im.gray, images)]

    def orientation(self, images: list[np.ndarray]) -> list[list[float]]:
        out = []
        for plain in map(im.gray, images):
            halves, sides = np.array_split(plain.astype(float), 2), np.array_split(plain.astype(float), 2, axis=1)
            out.append([float(part.mean()) / 32 for part in (halves[0], sides[1], halves[1], sides[0])])
        return out

    def detect(self, images: list[np.ndarray], min_conf: float) -> list[list[tuple[float, float, float, float, float, int]]]:
        return [[x for x in self._lines(im.gray(image)) if x[4] >= min_conf] for image in images]

    @staticmethod
    def _lines(plain: np.ndarray) -> list[tuple[float, float, float, float, float, int]]:
        ink = plain <= im.otsu(plain)
        rows = np.flatnonzero(np.diff(np.concatenate([[0], ink.any(axis=1).view(np.int8), [0]])))
        out = []
        for a, b in zip(rows[::2].tolist(), rows[1::2].tolist()):
            cols = np.flatnonzero(ink[a:b].any(axis=0))
            out.append((float(cols[0]), float(a), float(cols[-1] + 1), float(b), 0.5, 0))
        return out

    def read(self, crops: list[np.ndarray]) -> list[tuple[str, float]]:
        return [(hashlib.md5(c.tobytes()).hexdigest()[:6], 0.99) if c.size else ("", 0.0) for c in crops]

    def tag(self, pages: list[tuple[list[str], list[tuple[int, int, int, int]]]]) -> list[list[tuple[int | None, list[float]]]]:
        out = []
        for tokens, _ in pages:
            found: list[tuple[int | None, list[float]]] = [(None, [0.0] * len(LABELS))]
            for i, token in enumerate(tokens[:510]):
                best = int(hashlib.md5(token.encode()).hexdigest(), 16) % len(LABELS)
                found.append((i, [6.0 if k == best else 0.0 for k in range(len(LABELS))]))
            out.append(found)
        return out


def loaded(scorer: Scorer) -> Scorer:
    """The worker's own copy, loaded at its first use. Keyed by what the scorer is made of: other settings are another scorer."""
    key = hashlib.sha256(cloudpickle.dumps(scorer)).hexdigest()
    if key not in _LOADED:
        scorer.load()
        _LOADED[key] = scorer
    return _LOADED[key]  # type: ignore[return-value]


def _map_batches(frame: DataFrame, columns: list[str], schema: str, scorer: Scorer, rows, profile: ResourceProfile | None = None) -> DataFrame:
    """rows(loaded scorer, rows of an Arrow batch) -> rows, in tasks of the resource profile, if there is one."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = None
        for batch in batches:
            net = net or loaded(scorer)
            out = pd.DataFrame(rows(net, list(batch.itertuples(index=False))), columns=names)
            for c in nullable:
                out[c] = out[c].astype("Int32")
            yield out

    nullable = [part.split()[0] for part in schema.split(", ") if part.split()[1] == "int"]
    bound_batches(frame.sparkSession, IMAGE_BATCH)
    return frame.select(*columns).mapInPandas(run, schema, profile=profile)


def _gray_row(image: np.ndarray) -> tuple[int, int, bytes]:
    return image.shape[0], image.shape[1], np.ascontiguousarray(image).tobytes()


_IMAGE = ["image_id", "ok", "height", "width", "channels", "data"]
#: Why an image is not valid, in the order in which it is found out.
CAUSES = ("unreadable", "no mask", "empty mask", "no contour", "empty crop")


def cropped(image: np.ndarray, masks: list[tuple[float, np.ndarray]], min_conf: float, on_missing: str) -> np.ndarray:
    """The image inside its surest mask, cropped to the mask's largest region; raises with one of CAUSES."""
    sure = [m for m in masks if m[0] >= min_conf]
    if not sure:
        if on_missing == "error":
            raise ValueError("no mask")
        return image
    mask = max(sure, key=lambda m: m[0])[1]  # the first of equal ones
    if not mask.size or not mask.any():
        raise ValueError("empty mask")
    if im.largest_region(mask) is None:
        raise ValueError("no contour")
    out = im.crop_to_mask(im.apply_mask(image, mask), mask)
    if out is None or not out.size:
        raise ValueError("empty crop")
    return out


def _each(given: list, one) -> list:
    """one(x) of each x, or the exception that it raised: one bad image must not fail the job."""
    out = []
    for x in given:
        try:
            out.append(x if isinstance(x, Exception) else one(x))
        except Exception as e:
            out.append(e)
    return out


def _batched(given: list, call) -> list:
    """call on all that are no exceptions at once; if that raises, one by one, so that only the bad ones fail."""
    good = [x for x in given if not isinstance(x, Exception)]
    try:
        found = iter(call(good) if good else [])
        return [x if isinstance(x, Exception) else next(found) for x in given]
    except Exception:
        return _each(given, lambda x: call([x])[0])


def normalize_images(images: DataFrame, scorer: Scorer, on_missing: str = "passthrough", min_conf: float = SEGMENT_CONF, profile: ResourceProfile | None = None) -> DataFrame:
    """Segment, crop, turn upright, deskew and enhance.

    One row for every input: image_id, status (ok or error), error (one of
    CAUSES, or what a model raised), rotation, coarse_angle, refined_angle,
    best_score, height, width, gray. An image without a mask goes on whole
    (passthrough) or is an error (error). A failure in one image is its row's
    error, not the job's.
    """

    def decoded(r) -> np.ndarray:
        if not r.ok:
            raise ValueError("unreadable")
        return im.to_bgr8(im.decode(r.data, r.height, r.width, r.channels))

    def turned(image: np.ndarray, four: list[list[float]]) -> tuple:
        p0 = []
        for logits in map(np.array, four):
            p = np.exp(logits - logits.max())
            p0.append(p[0] / p.sum())
        rotation = (0, 90, 180, 270)[int(np.argmax(p0))]
        image = im.rotate_label(image, rotation)
        coarse = im.coarse_angle(image)
        angle, score = im.refine_angle(image, coarse)
        return rotation, round(coarse, 2), round(angle, 2), round(score, 4), *_gray_row(im.enhance(im.rotate_keep_canvas(image, angle)))

    def rows(net: Scorer, given: list) -> list[tuple]:
        whole = _each(given, decoded)
        masks = _batched(whole, net.segment)
        parts = _each([m if isinstance(m, Exception) else (x, m) for x, m in zip(whole, masks)], lambda x: cropped(*x, min_conf, on_missing))

        def upright(crops: list[np.ndarray]) -> list[list[list[float]]]:
            every = net.orientation([im.rotate_label(c, a) for c in crops for a in (0, 90, 180, 270)])
            return [every[i : i + 4] for i in range(0, len(every), 4)]

        logits = _batched(parts, upright)
        done = _each([x if isinstance(x, Exception) else (p, x) for p, x in zip(parts, logits)], lambda x: turned(*x))
        return [(r.image_id, "error", str(x)[:200], *[None] * 7) if isinstance(x, Exception) else (r.image_id, "ok", None, *x) for r, x in zip(given, done)]

    return _map_batches(images, _IMAGE, "image_id string, status string, error string, rotation int, coarse_angle double, refined_angle double, best_score double, height int, width int, gray binary", scorer, rows, profile)


def image_records(images: DataFrame, fail_on_error: bool = False) -> DataFrame:
    """Records of decoded images (with split, class_name and path): record_id, split_name, class_name, angle, path, canonical hashes.

    The hash is the least perceptual hash of the image's four rotations. An
    image that cannot be read has null hashes and ok = false; with
    fail_on_error any such image is an error. Records are numbered inside their
    split and class by path.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = _each(list(batch.itertuples(index=False)), lambda r: im.canonical_phash(im.to_bgr8(im.decode(r.data, r.height, r.width, r.channels))) if r.ok else None)
            out = batch[["path", "split", "class_name"]].copy()
            out["canonical_hash_int"] = pd.array([None if isinstance(h, Exception) else h for h in hashes], dtype="Int64")
            yield out

    bound_batches(images.sparkSession, IMAGE_BATCH)
    hashed = images.select("path", "split", "class_name", "ok", "height", "width", "channels", "data").mapInPandas(run, "path string, split string, class_name string, canonical_hash_int long")
    numbered = number_rows(hashed, ["path"], ["split", "class_name"])
    if fail_on_error and (bad := [r["path"] for r in numbered.where("canonical_hash_int IS NULL").select("path").limit(5).collect()]):
        raise ValueError(f"unreadable images, for example {bad}")
    name = record_id(F.col("split"), F.col("class_name"), F.col("number"))
    return numbered.select(name.alias("record_id"), F.col("split").alias("split_name"), "class_name", F.expr("try_cast(class_name AS int)").alias("angle"), "path", "canonical_hash_int", hash_hex(F.col("canonical_hash_int")).alias("canonical_hash_hex"), F.col("canonical_hash_int").isNotNull().alias("ok"))


def mask_visuals(images: DataFrame, scorer: Scorer, min_conf: float = SEGMENT_CONF) -> DataFrame:
    """PNG files of each image's surest mask and of its outline on the image: image_id, status, mask, visual (null without a mask)."""

    def one(x: tuple) -> tuple[bytes, bytes]:
        image, masks = x
        sure = [m for m in masks if m[0] >= min_conf]
        if not sure:
            raise ValueError("no mask")
        return tuple(map(im.encode_png, im.mask_visual(image, max(sure, key=lambda m: m[0])[1])))

    def rows(net: Scorer, given: list) -> list[tuple]:
        whole = _each(given, lambda r: im.to_bgr8(im.decode(r.data, r.height, r.width, r.channels)))
        masks = _batched(whole, net.segment)
        done = _each([m if isinstance(m, Exception) else (x, m) for x, m in zip(whole, masks)], one)
        return [(r.image_id, str(x)[:200], None, None) if isinstance(x, Exception) else (r.image_id, "ok", *x) for r, x in zip(given, done)]

    return _map_batches(images.where("ok"), _IMAGE, "image_id string, status string, mask binary, visual binary", scorer, rows)


def augmented_images(picks: DataFrame, images: DataFrame) -> DataFrame:
    """The picked images turned to their target class, as PNG files: target_class, source_class, record_id, rotation_applied, png."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turned = [im.encode_png(im.rotate_label(im.to_bgr8(im.decode(r.data, r.height, r.width, r.channels)), int(r.rotation_applied))) for r in batch.itertuples(index=False)]
            yield batch[["target_class", "source_class", "record_id", "rotation_applied"]].assign(png=turned)

    bound_batches(images.sparkSession, IMAGE_BATCH)
    given = picks.join(images.where("ok").select("path", "height", "width", "channels", "data"), "path")
    return given.select("target_class", "source_class", "record_id", "rotation_applied", "height", "width", "channels", "data").mapInPandas(run, "target_class string, source_class string, record_id string, rotation_applied long, png binary")


def detect_boxes(normalized: DataFrame, scorer: Scorer, min_conf: float = DETECTOR_CONF, profile: ResourceProfile | None = None) -> DataFrame:
    """Boxes of normalized images; the threshold goes into the scorer, as no filter is pushed through Python."""

    def rows(net: Scorer, given: list) -> list[tuple]:
        images = [np.frombuffer(r.gray, np.uint8).reshape(int(r.height), int(r.width)) for r in given]
        return [(r.image_id, i, *b[:5], int(b[5]), int(r.width), int(r.height)) for r, found in zip(given, net.detect(images, min_conf)) for i, b in enumerate(found)]

    return _map_batches(normalized.where("status = 'ok'"), ["image_id", "height", "width", "gray"], "image_id string, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, cls_id int, width int, height int", scorer, rows, profile)


def read_texts(normalized: DataFrame, boxes: DataFrame, scorer: Scorer, profile: ResourceProfile | None = None) -> DataFrame:
    """Text of every box, "" for an empty crop: image_id, box_idx, text, prob. The boxes of a batch of images are read in one call."""
    held = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_idx", *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))))).alias("boxes"))
    joined = normalized.where("status = 'ok'").select("image_id", "height", "width", "gray").join(held, "image_id")

    def rows(net: Scorer, given: list) -> list[tuple]:
        images = [np.frombuffer(r.gray, np.uint8).reshape(int(r.height), int(r.width)) for r in given]
        at = [(r.image_id, image, b) for r, image in zip(given, images) for b in r.boxes]
        found = net.read([image[b["y1"] : b["y2"], b["x1"] : b["x2"]] for _, image, b in at])
        return [(image_id, int(b["box_idx"]), text, float(p)) for (image_id, _, b), (text, p) in zip(at, found)]

    return _map_batches(joined, ["image_id", "height", "width", "gray", "boxes"], "image_id string, box_idx int, text string, prob double", scorer, rows, profile)


def tag_words(words: DataFrame, scorer: Scorer, profile: ResourceProfile | None = None) -> DataFrame:
    """Logits of sub-tokens of the words with text: image_id, token_idx, word_id (null for special ones), logits."""
    held = words.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("word_id", "text", "nx1", "ny1", "nx2", "ny2"))).alias("words"))

    def rows(net: Scorer, given: list) -> list[tuple]:
        pages = [([w["text"] for w in r.words], [(w["nx1"], w["ny1"], w["nx2"], w["ny2"]) for w in r.words]) for r in given]
        return [(r.image_id, i, word, [float(x) for x in logits]) for r, found in zip(given, net.tag(pages)) for i, (word, logits) in enumerate(found)]

    return _map_batches(held, ["image_id", "words"], "image_id string, token_idx int, word_id int, logits array<double>", scorer, rows, profile)
