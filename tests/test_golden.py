"""Published values reproduced from published inputs."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators import curation as cu
from foliospark.operators import entities as en
from foliospark.operators import evaluation as ev

# Precision, recall, F1 and support of 37 classes, in the order of the labels.
REPORT = """
0.9822 0.9940 0.9881 167
0.8000 0.6154 0.6957 26
0.9881 0.9765 0.9823 511
0.9942 0.9773 0.9857 176
0.9689 0.9341 0.9512 167
0.9625 0.9625 0.9625 160
0.9396 0.9524 0.9459 147
0.9739 0.9613 0.9675 155
0.9415 0.9365 0.9390 189
0.9627 0.9810 0.9718 158
0.7816 0.6800 0.7273 100
0.7857 0.7097 0.7458 93
0.9390 0.9078 0.9231 1779
0.9231 0.9783 0.9499 184
0.8933 0.9371 0.9147 143
0.9841 0.9201 0.9510 538
0.9130 0.9800 0.9453 150
0.6989 0.8228 0.7558 158
0.7613 0.7712 0.7662 153
0.9076 0.9153 0.9114 118
0.9412 0.9825 0.9614 114
0.9854 0.9951 0.9902 204
0.9784 0.9920 0.9852 502
0.9829 0.9663 0.9745 178
0.9221 0.9726 0.9467 73
0.9091 0.9677 0.9375 62
0.8776 0.9247 0.9005 93
0.9286 0.9785 0.9529 93
0.9824 0.9940 0.9882 168
0.9286 0.9548 0.9415 177
0.9278 0.9126 0.9201 183
0.9674 0.9468 0.9570 94
0.8286 1.0000 0.9062 29
0.9803 0.9868 0.9835 151
0.9778 1.0000 0.9888 44
0.9075 0.9812 0.9429 480
0.9765 0.9486 0.9623 175
"""
# Evaluation loss, accuracy and macro F1 of epochs 1 to 20, rounded, but for those that are given with more digits.
EPOCHS = [
    (0.5244, 0.861468, 0.769906), (0.3658, 0.903856, 0.864501), (0.3079, 0.924246, 0.894837), (0.2963, 0.933144, 0.918051), (0.3004, 0.930054, 0.914459),
    (0.2899, 0.932526, 0.916768), (0.2983, 0.934998, 0.918496), (0.3031, 0.935121, 0.918409), (0.3108, 0.934380, 0.919165), (0.3111, 0.933885, 0.917659),
    (0.322457, 0.933020, 0.919460), (0.3343, 0.937469, 0.922752), (0.3465, 0.936604, 0.922050), (0.3663, 0.933638, 0.918380), (0.3757, 0.937716, 0.924608),
    (0.3839, 0.937469, 0.922918), (0.3906, 0.938211, 0.924594), (0.3989, 0.937593, 0.924454), (0.4063, 0.93783984, 0.924484), (0.4070, 0.93783984, 0.924853),
]
# Fixed values: (token index, label, text) of a sample receipt, and the fields extracted from it.
TOKENS = [
    (0, "SHOP_NAME", "FICITEA 8 COFFEE"), (3, "TITLE", "HOA ĐƠN"), (14, "PRODUCT_NAME", "Trân châu Truyền"), (15, "AMOUNT", "2"), (16, "AMOUNT", "2"), (17, "UPRICE", "19.000"),
    (21, "AMOUNT", "2"), (22, "UPRICE", "5.000"), (25, "PRODUCT_NAME", "Cookiesa Cream"), (26, "AMOUNT", "1"), (29, "PRODUCT_NAME", "Sữa tươi Trần châu"), (30, "AMOUNT", "1"),
    (33, "PRODUCT_NAME", "Dương đen"), (34, "AMOUNT", "1"), (36, "PRODUCT_NAME", "Trân châu đen"),
]
FIELDS = {"SHOP_NAME": "FICITEA 8 COFFEE", "TITLE": "HOA ĐƠN", "PRODUCT_NAME": "Trân châu Truyền Cookiesa Cream Sữa tươi Trần châu Dương đen Trân châu đen", "AMOUNT": "2 2 2 1 1 1", "UPRICE": "19.000 5.000"}


def test_report_averages(spark):
    rows = [(float(p), float(r), float(f), int(n), round(float(r) * int(n))) for p, r, f, n in (line.split() for line in REPORT.split("\n") if line)]
    out = ev.averages(spark.createDataFrame(rows, "precision double, recall double, f1 double, support long, hits long")).first()
    assert (round(out.macro_precision, 4), round(out.macro_recall, 4), round(out.macro_f1, 4)) == (0.9217, 0.9302, 0.9249)
    assert (round(out.weighted_precision, 4), round(out.weighted_recall, 4), round(out.weighted_f1, 4)) == (0.9388, 0.9378, 0.9378)
    assert out.accuracy == pytest.approx(7589 / 8092) and out.support == 8092


def test_best_epochs(spark):
    history = spark.createDataFrame([(i, *v) for i, v in enumerate(EPOCHS, 1)], "epoch int, loss double, accuracy double, f1 double")
    assert ev.best_epoch(history, "f1").first().epoch == 20
    assert ev.best_epoch(history, "accuracy").first().epoch == 17
    assert ev.best_epoch(history, "loss", largest=False).first().epoch == 6


def test_fields_in_token_order(spark):
    rows = spark.createDataFrame([("r", *t) for t in TOKENS[::-1]], "image_id string, idx int, label string, text string")
    joined = en.joined_by_label(rows).orderBy("first_idx").collect()
    assert {r.label: r.value for r in joined} == FIELDS
    assert [r.label for r in joined] == ["SHOP_NAME", "TITLE", "PRODUCT_NAME", "AMOUNT", "UPRICE"]


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.range(400).selectExpr("lpad(cast(id AS string), 5, '0') AS record_id", "id * 7919 % 83 AS canonical_hash_int")
    seen = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        groups = cu.document_groups(rows.repartition(n)).select("record_id", "document_group_id")
        joined = en.joined_by_label(rows.repartition(n).select(F.lit("i").alias("image_id"), F.col("record_id").alias("text"), F.col("canonical_hash_int").cast("string").alias("label"), F.col("record_id").cast("int").alias("idx")))
        seen.append((sorted(map(tuple, groups.collect())), sorted(map(tuple, joined.collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1]
