"""Detected boxes: filtering, line merging, reading order."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import ceil, floor, inf, log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import MAX_CENTRE, MAX_GAP, MAX_OVERLAP, MIN_AREA, box_area, expand_box, merge_boxes, same_line
from ..schemas import DETECTOR_CONF, NMS_IOU
from ..storage import bound_batches

CORNERS = ("x1", "y1", "x2", "y2")
#: Rows of an Arrow batch where a row is a band of an image.
IMAGE_BANDS = 1024
_MERGED = "image_id {key}, band long, place int, x1 double, y1 double, x2 double, y2 double, conf double, cls_id int"


def postprocess(detections: DataFrame, min_conf: float = DETECTOR_CONF, min_area: int = MIN_AREA) -> DataFrame:
    """Sure detections, grown, clipped and large enough. Needs width and height."""
    sure = detections.where(F.col("conf") >= min_conf)
    grown = expand_box(CORNERS, F.col("width"), F.col("height"))
    return sure.withColumns(grown).where(box_area(CORNERS) >= min_area)


def in_bands(boxes: DataFrame) -> DataFrame:
    """Boxes with the band of their image: a new one begins wherever no box is crossed from left to right.

    Boxes of one line, merged ones too, overlap in height, so lines never leave
    their band, and a crowded image is as many groups as it has bands.
    """
    down = Window.partitionBy("image_id").orderBy(F.least("y1", "y2"), "box_idx")
    reached = F.max(F.greatest("y1", "y2")).over(down.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.least("y1", "y2") >= reached, F.lit(True)).cast("long")
    return boxes.withColumn("starts", starts).withColumn("band", F.sum("starts").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def _on_one_line(boxes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One self-join on the image's band: columns a, b (a < b) and a_*, b_* of the names. Both sides share their shuffle."""
    banded = in_bands(boxes.select("image_id", "box_idx", *names))
    side = lambda t: banded.select("image_id", "band", F.col("box_idx").alias(t), *(F.col(c).alias(f"{t}_{c}") for c in names))
    corners = lambda t: tuple(f"{t}_{c}" for c in CORNERS)
    return side("a").join(side("b"), ["image_id", "band"]).where((F.col("a") < F.col("b")) & same_line(corners("a"), corners("b")))


def line_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs of one image's boxes that belong to one line: image_id, a, b with a < b."""
    return _on_one_line(boxes, CORNERS).select("image_id", "a", "b")


def merged_pairs(boxes: DataFrame) -> DataFrame:
    """Envelopes of line pairs; boxes carry conf and cls_id."""
    names = (*CORNERS, "conf", "cls_id")
    merged = merge_boxes(tuple(f"a_{c}" for c in names), tuple(f"b_{c}" for c in names))
    return _on_one_line(boxes, names).select("image_id", "a", "b", *(v.alias(k) for k, v in merged.items()))


def reading_order(boxes: DataFrame) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy("y1", "x1", "box_idx")
    return boxes.withColumn("position", F.row_number().over(order) - 1)


def _one_line(a: list, b: list) -> bool:
    tall = max(a[3] - a[1], b[3] - b[1])
    if tall == 0 or abs((a[1] + a[3]) - (b[1] + b[3])) / 2 > MAX_CENTRE * tall:
        return False
    narrow, shared = min(a[2] - a[0], b[2] - b[0]), min(a[2], b[2]) - max(a[0], b[0])
    return not (narrow > 0 and shared / narrow > MAX_OVERLAP) and -shared <= MAX_GAP * tall


class _Sweep:
    """Free boxes, asked for those that a growing line may reach.

    Boxes are kept by the power of two of their height and width, in rows of
    that height by their centre, in a row by their left side. Inside a class
    the reach is known up to a factor of two, so a question looks at a few rows
    and at one stretch of each; what the line has been told is not looked at
    again, and taken boxes are leapt over.
    """

    def __init__(self, boxes: list[list]):
        rows: dict[tuple[float, float], dict[int, list[tuple[float, int]]]] = {}
        for i, b in enumerate(boxes):
            tall, wide = _power(b[3] - b[1]), _power(b[2] - b[0])
            rows.setdefault((tall, wide), {}).setdefault(floor((b[1] + b[3]) / 2 / (tall or 1.0)), []).append((b[0], i))
        #: (height, width, numbers of the rows, per row: left sides, boxes, the next one that is free)
        self.classes = []
        self.place: list[tuple[list[int], int]] = [([], 0)] * len(boxes)
        for (tall, wide), found in rows.items():
            held = {}
            for number, row in found.items():
                row.sort()
                following = list(range(len(row) + 1))
                held[number] = ([x for x, _ in row], [i for _, i in row], following)
                for k, (_, i) in enumerate(row):
                    self.place[i] = (following, k)
            self.classes.append((tall, wide, sorted(held), held))

    def take(self, i: int) -> None:
        following, k = self.place[i]
        following[k] = k + 1

    def reached(self, line: list, told: dict[tuple[int, int], tuple[int, int]]) -> Iterator[int]:
        """Free boxes near the line that it has not been told of; told: per class and row the stretch it has been."""
        height, centre = line[3] - line[1], (line[1] + line[3]) / 2
        for c, (tall, wide, numbers, held) in enumerate(self.classes):
            reach = max(height, tall) * (1 + 1e-9)
            if reach <= 0:
                continue
            unit, far, gap = tall or 1.0, MAX_CENTRE * reach, MAX_GAP * reach
            low, high = floor((centre - far) / unit) - 1, floor((centre + far) / unit) + 1
            for at in range(bisect_left(numbers, low), bisect_right(numbers, high)):
                lefts, ids, following = held[numbers[at]]
                slack = 1e-9 * (abs(line[0]) + abs(line[2]) + 1)
                start, stop = bisect_left(lefts, line[0] - gap - wide - slack), bisect_right(lefts, line[2] + gap + slack)
                before = told.get((c, at))
                for a, b in ((start, stop),) if before is None else ((start, before[0]), (before[1], stop)):
                    k = _free(following, a) if a < b else b
                    while k < b:
                        yield ids[k]
                        k = _free(following, k + 1)
                told[c, at] = (start, stop) if before is None else (min(start, before[0]), max(stop, before[1]))


def _power(size: float) -> float:
    """The least power of two that is no smaller; 0 for no size."""
    return 2.0 ** ceil(log2(size)) if size > 0 else 0.0


def _free(following: list[int], k: int) -> int:
    end = k
    while following[end] != end:
        end = following[end]
    while following[k] != end:
        following[k], k = end, following[k]
    return end


def absorb_lines(boxes: list[list]) -> list[list]:
    """Merge boxes [x1, y1, x2, y2, conf, cls] greedily into lines.

    From the top left, a box takes in whatever lies on its line, tested in
    order against the grown box, until a whole pass finds nothing; then the next
    free box. Only boxes within reach are tested.
    """
    if len(boxes) < 2:
        return [list(b) for b in boxes]
    order, lines = sorted(boxes, key=lambda b: (b[1], b[0])), []
    sweep, taken = _Sweep(order), [False] * len(order)
    for first, box in enumerate(order):
        if taken[first]:
            continue
        sweep.take(first)
        line, told = list(box), {}
        ahead, behind, grew = list(sweep.reached(line, told)), [], False
        heapify(ahead)
        while ahead:
            at = heappop(ahead)
            b = order[at]
            if _one_line(line, b):
                taken[at] = grew = True
                sweep.take(at)
                surer = line if line[4] >= b[4] else b
                line = [min(line[0], b[0]), min(line[1], b[1]), max(line[2], b[2]), max(line[3], b[3]), max(line[4], b[4]), surer[5]]
                for new in sweep.reached(line, told):
                    if new > at:
                        heappush(ahead, new)
                    else:
                        behind.append(new)
            else:
                behind.append(at)
            if not ahead and grew:  # another pass
                ahead, behind, grew = behind, [], False
                heapify(ahead)
        lines.append(line)
    return sorted(lines, key=lambda b: (b[1], b[0]))


def merge_lines(boxes: DataFrame) -> DataFrame:
    """Merged lines of each image in reading order: image_id, box_idx, corners, conf, cls_id.

    The merge is a fixpoint that depends on the order, which no join
    expresses; only a band of an image is one row of a task. Images are
    shuffled once, their lines again to be numbered.
    """
    key = boxes.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for image, band, rows in zip(batch["image_id"], batch["band"], batch["boxes"]):
                found = absorb_lines([[b["x1"], b["y1"], b["x2"], b["y2"], b["conf"], b["cls_id"]] for b in rows])
                out += [(image, band, i, *b) for i, b in enumerate(found)]
            yield pd.DataFrame(out, columns=["image_id", "band", "place", *CORNERS, "conf", "cls_id"])

    box = F.struct("box_idx", *(F.col(c).cast("double").alias(c) for c in (*CORNERS, "conf")), F.col("cls_id").cast("int").alias("cls_id"))
    bands = in_bands(boxes.select("image_id", "box_idx", "y1", "y2", box.alias("box")))
    held = bands.groupBy("image_id", "band").agg(F.array_sort(F.collect_list("box")).alias("boxes"))
    lines = held.mapInPandas(run, _MERGED.format(key=key))
    order = Window.partitionBy("image_id").orderBy("y1", "x1", "band", "place")
    return lines.select("image_id", (F.row_number().over(order) - 1).alias("box_idx"), *CORNERS, "conf", "cls_id")


class _Kept:
    """Kept boxes, asked whether one of them overlaps a box too much.

    Boxes are kept by the powers of two of their width and height, in cells of
    that size by their centre. Boxes that share more than max_overlap of their
    union are alike in size, so few classes are looked at; and as kept boxes
    hardly overlap, a cell holds few of them, however many boxes there are.
    """

    def __init__(self, max_overlap: float):
        self.max_overlap = max_overlap
        self.unlike = 2 / max_overlap * (1 + 1e-9) if max_overlap > 0 else inf  # powers of two are off by less than two
        self.classes: dict[tuple[float, float], dict[tuple[int, int], list[tuple]]] = {}

    def add(self, box: tuple) -> None:
        x1, y1, x2, y2, _ = box
        wide, tall = _power(x2 - x1), _power(y2 - y1)
        cell = floor((x1 + x2) / 2 / wide), floor((y1 + y2) / 2 / tall)
        self.classes.setdefault((wide, tall), {}).setdefault(cell, []).append(box)

    def overlaps(self, box: tuple) -> bool:
        x1, y1, x2, y2, area = box
        width, height, across, down = _power(x2 - x1), _power(y2 - y1), (x1 + x2) / 2, (y1 + y2) / 2
        for (wide, tall), cells in self.classes.items():
            if max(wide / width, width / wide, tall / height, height / tall) > self.unlike:
                continue
            far, deep = (wide + width) / 2, (tall + height) / 2
            columns = range(floor((across - far) / wide), floor((across + far) / wide) + 1)
            rows = range(floor((down - deep) / tall), floor((down + deep) / tall) + 1)
            near = cells if len(cells) < len(columns) * len(rows) else ((c, r) for c in columns for r in rows)
            for at in near:
                for a1, b1, a2, b2, other in cells.get(at, ()):
                    shared = max(min(x2, a2) - max(x1, a1), 0.0) * max(min(y2, b2) - max(y1, b1), 0.0)
                    if shared > self.max_overlap * max(other + area - shared, 1e-9):
                        return True
        return False


def survivors(boxes: list[tuple], max_overlap: float) -> list[int]:
    """Places of the boxes (x1, y1, x2, y2), surest first, that overlap none of the kept ones before them too much."""
    kept, out = _Kept(max_overlap), []
    for i, corners in enumerate(boxes):
        x1, y1, x2, y2 = (float("nan") if c is None else c for c in corners)
        if x2 > x1 and y2 > y1:  # others have no area to share, and null corners none that is known
            box = (x1, y1, x2, y2, (x2 - x1) * (y2 - y1))
            if kept.overlaps(box):
                continue
            kept.add(box)
        out.append(i)
    return out


def suppress(detections: DataFrame, max_overlap: float = NMS_IOU, per_class: bool = False) -> DataFrame:
    """Greedy non-maximum suppression: the detections of each image that share at most max_overlap of their union with each surer one that is kept.

    Equally sure ones go by det_idx, those without conf come last; per_class:
    only detections of one cls_id suppress each other. All columns stay as they
    are. Boxes without area or with a null corner stay and suppress nothing;
    an empty table gives an empty one. Each image is a group of a shuffle, but
    only a band of it that no box crosses is one row of a task.
    """
    bound_batches(detections.sparkSession, IMAGE_BANDS)
    key = ["image_id", *(["cls_id"] if per_class else [])]
    given = detections.select(*(F.col(c).alias(f"key_{i}") for i, c in enumerate(key)), F.struct("*").alias("row"))
    corners = [F.col(f"row.{c}").cast("double").alias(c) for c in CORNERS]
    sure = F.coalesce(-F.col("row.conf").cast("double"), F.lit(inf)).alias("unsure")
    boxes = given.select(F.struct(*(f"key_{i}" for i in range(len(key)))).alias("image_id"), F.col("row.det_idx").alias("box_idx"), F.col("row.y1").alias("y1"), F.col("row.y2").alias("y2"), F.struct(sure, F.col("row.det_idx").alias("place"), *corners).alias("box"), "row")
    # The order is by the box alone: rows may hold columns that have no order.
    held = in_bands(boxes).groupBy("image_id", "band").agg(F.collect_list(F.struct("box", "row")).alias("boxes"))
    ordered = held.select(F.array_sort(F.transform("boxes", lambda b, i: F.struct(b["box"].alias("box"), i.alias("i")))).alias("order"), "boxes")

    @F.pandas_udf("array<int>")
    def kept(bands: pd.Series) -> pd.Series:
        return bands.map(lambda band: survivors([(b["x1"], b["y1"], b["x2"], b["y2"]) for b in band], max_overlap))

    found = ordered.withColumn("kept", kept(F.col("order.box")))
    rows = found.select(F.explode(F.transform("kept", lambda i: F.get("boxes", F.get("order", i)["i"])["row"])).alias("row"))
    return rows.select("row.*")
