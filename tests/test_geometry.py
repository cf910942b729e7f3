import random
import time
from functools import reduce

from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.operators import boxes as bx


def test_normalize_golden(spark):
    rows = [(125, 102, 336, 122, 264, 169, 710, 202), (75, 125, 374, 141, 158, 207, 790, 234), (192, 145, 275, 155, 405, 240, 581, 257)]
    df = spark.createDataFrame(rows, "x1 int, y1 int, x2 int, y2 int, a int, b int, c int, d int")
    out = df.select("a", "b", "c", "d", *(v.alias(k) for k, v in g.normalize_box(bx.CORNERS, F.lit(473), F.lit(602)).items())).collect()
    assert all((r.a, r.b, r.c, r.d) == (r.nx1, r.ny1, r.nx2, r.ny2) for r in out)


def test_clip_rounds_half_to_even_and_orders(spark):
    df = spark.createDataFrame([(2.5, 3.5, 1.5, 0.5), (-4.0, -1.0, 300.0, 90.0)], "x1 double, y1 double, x2 double, y2 double")
    out = [tuple(r) for r in df.select(*(v.alias(k) for k, v in g.clip_box(bx.CORNERS, F.lit(100), F.lit(50)).items())).collect()]
    assert out == [(2, 0, 2, 4), (0, 0, 100, 50)]


def test_area_boundary(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 4.0, 0.9), (1, 0.0, 0.0, 5.0, 3.0, 0.9), (2, 0.0, 0.0, 9.0, 9.0, 0.07)], "i int, x1 double, y1 double, x2 double, y2 double, conf double").withColumns({"width": F.lit(100), "height": F.lit(100)})
    assert [r.i for r in bx.postprocess(df).collect()] == [0]


def test_yolo_line(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 60.0)], "x1 double, y1 double, x2 double, y2 double")
    line = df.select(g.yolo_line(F.lit(0), g.yolo_fields(bx.CORNERS, F.lit(100), F.lit(200))).alias("v")).first().v
    assert line == "0 0.200000 0.200000 0.200000 0.200000"


def test_six_decimals_are_those_of_the_binary_value(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, 0.5, 0.0000005, 0.0000015, 0.9999995, 0.99999949999] + [k / 10**7 for k in rng.sample(range(5, 10**7, 10), 4000)] + [rng.random() for _ in range(2000)] + [k / 2**21 for k in rng.sample(range(2**21), 2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(g.six_decimals(F.col("v")).alias("s")).collect()] == [f"{v:.6f}" for v in values]


def settle(line, others):
    """Fold the others into a line, in their order, until a fold leaves all of them."""

    def take(state, box):
        grown, left = state
        if not bx._one_line(grown, box):
            return grown, [*left, box]
        corners = [f(x, y) for f, x, y in zip((min, min, max, max, max), grown, box)]
        return [*corners, (grown if grown[4] >= box[4] else box)[5]], left

    grown, left = reduce(take, others, (line, []))
    return (grown, left) if len(left) == len(others) else settle(grown, left)


def by_definition(boxes):
    """Lines of boxes in reading order, recursively."""
    if not boxes:
        return []
    line, left = settle(boxes[0], boxes[1:])
    return [line, *by_definition(left)]


def test_line_merge_against_its_definition(spark):
    rng = random.Random(5)
    images = {}
    for k in range(300):
        images[k] = [[x := rng.randint(0, 60), y := rng.randint(0, 30), x + rng.randint(0, 25), y + rng.randint(0, 12), rng.random(), rng.randint(0, 2)] for _ in range(rng.randint(0, 9))]
    rows = [(k, i, *map(float, b[:5]), b[5]) for k, bs in images.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "image_id int, box_idx int, x1 double, y1 double, x2 double, y2 double, conf double, cls_id int")
    got = {}
    for r in bx.merge_lines(df).orderBy("image_id", "box_idx").collect():
        got.setdefault(r.image_id, []).append([r.x1, r.y1, r.x2, r.y2, r.conf, r.cls_id])
    for k, bs in images.items():
        if bs:
            place = lambda b: (b[1], b[0])
            assert got[k] == sorted(by_definition(sorted(bs, key=place)), key=place)
            assert len(got[k]) <= len(bs)


def test_lines_of_crowded_and_odd_boxes():
    """The sweep against the definition: dense boxes of very different sizes, without height or width, and turned corners."""
    rng = random.Random(9)
    place = lambda b: (b[1], b[0])
    for k in range(250):
        wide, tall = rng.choice([(40, 10), (300, 30), (60, 400)]), rng.choice([3, 12, 90])
        boxes = [[x := rng.uniform(-wide[0], wide[0]), y := rng.uniform(0, wide[1]), x + rng.choice([0, 1, 5, 40, -3]) * rng.random(), y + rng.choice([0, 1, 1, -0.5]) * tall * rng.random(), rng.random(), rng.randint(0, 2)] for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            boxes = [[float(round(v)) for v in b[:5]] + b[5:] for b in boxes]
        assert bx.absorb_lines(boxes) == sorted(by_definition(sorted(boxes, key=place)), key=place)


def test_twenty_thousand_boxes_on_one_image(spark):
    """A page of many short lines, one line of all boxes, and a heap of boxes that cover each other: seconds each."""
    import time

    rng = random.Random(3)
    page = [(0, i, 12.0 * (i % 40), 14.0 * (i // 40) + rng.random(), 12.0 * (i % 40) + 10, 14.0 * (i // 40) + 10, 0.9, 0) for i in range(20_000)]
    row = [(1, i, 11.0 * i, rng.random(), 11.0 * i + 10, 10.0, 0.9, 0) for i in range(20_000)]
    heap = [(2, i, rng.uniform(0, 4000), rng.uniform(0, 4000), 0.0, 0.0, 0.9, 0) for i in range(20_000)]
    heap = [(*b[:4], b[2] + rng.uniform(4, 90), b[3] + rng.uniform(4, 12), 0.9, 0) for b in heap]
    df = spark.createDataFrame(page + row + heap, "image_id int, box_idx int, x1 double, y1 double, x2 double, y2 double, conf double, cls_id int").repartition(4)
    start = time.perf_counter()
    got = {r["image_id"]: r["n"] for r in bx.merge_lines(df).groupBy("image_id").agg(F.count("*").alias("n")).collect()}
    assert got[0] == 500 and got[1] == 1 and 1 < got[2] < 20_000
    assert time.perf_counter() - start < 90


def test_line_pairs_of_a_crowded_image(spark):
    """Pairs by bands are the pairs of the image; twenty thousand boxes are not squared."""
    rng = random.Random(4)
    some = [[0, i, x := rng.uniform(0, 200), y := rng.uniform(0, 900), x + rng.choice([0, 9, 30]), y + rng.choice([0, 4, 12])] for i in range(300)]
    make = lambda rows: spark.createDataFrame(rows, "image_id int, box_idx int, x1 double, y1 double, x2 double, y2 double")
    want = {(a[1], b[1]) for a in some for b in some if a[1] < b[1] and bx._one_line(a[2:], b[2:])}
    assert {(r.a, r.b) for r in bx.line_pairs(make(some)).collect()} == want and want
    page = [(1, i, 12.0 * (i % 40), 14.0 * (i // 40), 12.0 * (i % 40) + 10, 14.0 * (i // 40) + 10) for i in range(20_000)]
    assert bx.line_pairs(make(page)).count() == 500 * 39


def plain_suppression(boxes, most):
    kept = []
    for i, (x1, y1, x2, y2) in enumerate(boxes):
        for k in kept:
            a1, b1, a2, b2 = boxes[k]
            shared = max(min(x2, a2) - max(x1, a1), 0) * max(min(y2, b2) - max(y1, b1), 0)
            if shared > most * max((a2 - a1) * (b2 - b1) + (x2 - x1) * (y2 - y1) - shared, 1e-9):
                break
        else:
            kept.append(i)
    return kept


def test_survivors_are_those_of_all_comparisons():
    rng = random.Random(5)
    for most in (0.0, 0.1, 0.45, 0.9, 1.0):
        for span in (30, 120):
            boxes = []
            for _ in range(300):
                x, y, w, h = rng.randrange(-span, span), rng.randrange(span), rng.choice([0, 1, 3, 8, 20, 21, 90]), rng.choice([0, 0.5, 2, 8, 9, 40])
                boxes.append((float(x), float(y), float(x + w), float(y + h)))
            assert bx.survivors(boxes, most) == plain_suppression(boxes, most)


def test_suppression(spark):
    names = "image_id string, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, cls_id int, row int, band map<string,int>"
    rows = [
        ("a", 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0, 1, {"k": 1}), ("a", 1, 1.0, 1.0, 10.0, 10.0, 0.8, 1, None, None), ("a", 2, 20.0, 0.0, 30.0, 10.0, 0.7, 0, 2, None),
        ("a", 3, 20.0, 0.0, 30.0, 10.0, 0.7, 0, 2, None), ("a", 4, 0.0, 0.0, 10.0, 10.0, None, 0, 2, None), ("a", 5, None, 0.0, 10.0, 10.0, 0.99, 0, 2, None),
        (None, 0, 0.0, 0.0, 10.0, 10.0, 0.1, 0, 1, None), (None, 0, 0.0, 0.0, 10.0, 10.0, 0.1, 0, 1, None), ("b", 7, 0.0, 0.0, 10.0, 10.0, 0.1, None, 1, None),
    ]
    df = spark.createDataFrame(rows, names)
    got = bx.suppress(df)
    assert got.columns == df.columns
    key = lambda r: (r.image_id or "", r.det_idx)
    assert sorted(map(key, got.collect())) == [("", 0), ("a", 0), ("a", 2), ("a", 5), ("b", 7)]
    assert [r.band for r in got.collect() if key(r) == ("a", 0)] == [{"k": 1}]
    assert sorted(map(key, bx.suppress(df, per_class=True).collect())) == [("", 0), ("a", 0), ("a", 1), ("a", 2), ("a", 5), ("b", 7)]
    assert bx.suppress(df.limit(0)).collect() == []


def test_suppression_of_a_crowded_image():
    rng = random.Random(2)
    boxes = [(x, y, x + rng.uniform(5, 60), y + rng.uniform(4, 12)) for x, y in ((rng.uniform(0, 2000), rng.uniform(0, 3000)) for _ in range(50_000))]
    start = time.perf_counter()
    assert 20_000 < len(bx.survivors(boxes, 0.45)) < 50_000
    assert time.perf_counter() - start < 60
