import collections
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import curation as cu
from foliospark.operators import evaluation as ev
from foliospark.operators import least_used as lu
from foliospark.operators import routing as ro
from foliospark.plans import registry

DIR = "/root/testdata/sf0.001"


def test_hash_pairs_against_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(40)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(63), rng.randint(1, 6))) for b in base for _ in range(3)] + base[:5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "record_id int, canonical_hash_int long")
    for distance in range(5):
        want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= distance}
        assert {tuple(r) for r in cu.near_pairs(df, distance).collect()} == want


def test_hash_pairs_under_a_crowded_band(spark):
    """Hashes with common bits are divided again and again; all of a small ball, and hashes of both signs, are compared."""
    rng = random.Random(6)
    values = {rng.getrandbits(40) << 22 for _ in range(1500)} | {rng.getrandbits(12) << 50 for _ in range(800)} | {1 << i for i in range(63)} | {0}
    values |= {v ^ 1 << rng.randrange(64) for v in rng.sample(sorted(values), 300)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "canonical_hash_int long")
    bits = [v & (1 << 64) - 1 for v in values]
    for distance in (1, 2, 3):
        want = {(*sorted((values[i], values[j])), (bits[i] ^ bits[j]).bit_count()) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= distance}
        got = [tuple(r) for r in cu.hash_pairs(df, distance).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_million_hashes_half_of_them_alike_in_a_band(spark):
    n = 1_000_000
    far = F.xxhash64("id")
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.shiftleft(far, 22)).otherwise(far).alias("h"), "id")
    twin = rows.where("id % 1000 < 2").select(F.expr("h ^ shiftleft(1L, cast(id % 63 AS int))").alias("h"))
    made = rows.select("h").unionByName(twin).withColumnRenamed("h", "canonical_hash_int")
    found = {r["hamming_distance"]: r["count"] for r in cu.hash_pairs(made, 2).groupBy("hamming_distance").count().collect()}
    assert found[1] >= 2000 and sum(found.values()) < 4000


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(100, 101)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 100, 101, 200]], "node int")
    got = {r.node: r.component for r in cu.components(edges, nodes).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 200: 200}


def records(spark, counts):
    rows = [(f"r{c}_{i:03d}", "train", c, f"/p/{c}/{i}", 1000 * int(c) + i, "") for c, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "record_id string, split_name string, class_name string, path string, canonical_hash_int long, canonical_hash_hex string")
    return cu.document_groups(df)


def test_balance_and_manifest(spark):
    rows = records(spark, {"0": 9, "90": 3, "180": 5, "270": 8})
    dim = spark.createDataFrame([("0",), ("90",), ("180",), ("270",)], ["class_name"])
    picks = cu.balance(rows, dim)
    got = picks.collect()
    assert all(p.source_class != p.target_class and p.rotation_applied == (int(p.target_class) - int(p.source_class)) % 360 for p in got)
    assert len({(p.target_class, p.document_group_id) for p in got}) == len(got)
    totals = {r.target_class: r.n for r in cu.manifest(rows, picks).groupBy("target_class").agg(F.count("*").alias("n")).collect()}
    assert set(totals.values()) == {9}
    report = cu.curation_report(cu.manifest(rows, picks)).first()
    assert report.total == 36


def test_numbers_of_a_million_groups_and_of_tiny_partitions(spark):
    n = 1_000_000
    rows = spark.range(n).selectExpr("lpad(cast(id AS string), 8, '0') AS record_id", "xxhash64(id) AS canonical_hash_int")
    got = cu.document_groups(rows).selectExpr("count(*)", "count(DISTINCT document_group_id)", "count_if(document_group_id <> format_string('doc_%06d', cast(record_id AS long)))").first()
    assert tuple(got) == (n, n, 0)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        few = cu.number_rows(rows.limit(300_000).withColumn("k", F.when(F.col("record_id") % 3 != 0, "hot")), ["record_id"], ["k"])
        assert few.groupBy("k").agg(F.count("*"), F.count_distinct("number"), F.max("number")).orderBy("k").collect() == [(None, 100_000, 100_000, 99_999), ("hot", 200_000, 200_000, 199_999)]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def walked(rows):
    """Picks one after the other."""
    used, out = {}, {}
    for target, number, options in sorted(rows):
        mine = used.setdefault(target, collections.Counter())
        out[target, number] = min(options, key=lambda c: (mine[c], c))
        mine[out[target, number]] += 1
    return out


def test_least_used_is_one_walk(spark):
    """Stretches that start guessed: options that overlap, one class far ahead of the others, and long runs of one kind."""
    rng = random.Random(2)
    sets = [o for n in (1, 2, 3) for o in itertools.combinations(range(4), n)]
    rows = [("mixed", i, rng.choice(sets)) for i in range(2000)]
    rows += [("ahead", i, (0,) if i % 3 else rng.choice([(0, 1), (1, 2), (0, 2, 3)])) for i in range(1500)]
    rows += [("runs", i, sets[i // 130 % len(sets)]) for i in range(1700)] + [("one", 0, (3,))]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame([(t, i, list(o)) for t, i, o in shuffled], "target string, number long, options array<int>")
    got = {(r.target, r.number): r.choice for r in lu.least_used(df, 4, stretch=37).collect()}
    assert got == walked(rows)


def test_pieces_hold_where_they_say(spark):
    rng = random.Random(8)
    sets = [o for n in (1, 2, 3) for o in itertools.combinations(range(3), n)]
    inside = 0
    for _ in range(300):
        stretch = [rng.choice(sets) for _ in range(rng.randint(0, 12))]
        piece = lu.go_through(stretch, tuple(rng.randint(0, 4) for _ in range(3)))
        start = tuple(rng.randint(0, 6) for _ in range(3))
        inside += piece.holds(start)
        if piece.holds(start):
            assert lu.go_through(stretch, start).picks == piece.picks
    assert inside > 30


def test_records_without_a_hash_are_groups_of_their_own(spark):
    df = spark.createDataFrame([("a", 5), ("b", None), ("c", 5), ("d", None), ("e", 4)], "record_id string, canonical_hash_int long")
    for distance, want in ((0, 4), (1, 3)):
        got = {r.record_id: r.document_group_id for r in cu.document_groups(df, distance).collect()}
        assert len(got) == 5 and len(set(got.values())) == want and got["a"] == got["c"] == "doc_000000"


def test_too_few_groups_raise(spark):
    rows = records(spark, {"0": 5}).withColumn("document_group_id", F.lit("doc_000000"))
    dim = spark.createDataFrame([("0",), ("90",)], ["class_name"])
    with pytest.raises(ValueError, match="not enough"):
        cu.balance(rows, dim)


def test_counts_with_empty_class(spark):
    rows = spark.createDataFrame([("0",)] * 3, ["class_name"])
    dim = spark.createDataFrame([("0",), ("90",)], ["class_name"])
    got = {r.class_name: r for r in cu.class_counts(rows, dim).collect()}
    assert got["90"].n == 0 and got["0"].percentage == 100.0 and got["0"].ratio == float("inf") and got["0"].advice == "missing"


def test_leakage(spark):
    rows = [("a", "train", "0", "p", 5, ""), ("b", "valid", "0", "p", 5, ""), ("c", "test", "0", "p", 7, ""), ("d", "test", "0", "p", 5 + (1 << 40), "")]
    df = spark.createDataFrame(rows, "record_id string, split_name string, class_name string, path string, canonical_hash_int long, canonical_hash_hex string")
    near = {(r.record_id_a, r.record_id_b, r.hamming_distance) for r in cu.split_leakage(df, 1).collect()}
    assert near == {("a", "b", 0), ("a", "c", 1), ("b", "c", 1), ("a", "d", 1), ("b", "d", 1)}
    for distance in (0, 1):
        pairs = [tuple(r) for r in cu.split_leakage(df, distance).select("split_a", "split_b", "record_id_a", "record_id_b").collect()]
        want = {k: (len(v), len({x[2] for x in v}), len({x[3] for x in v})) for k in {p[:2] for p in pairs} for v in [[p for p in pairs if p[:2] == k]]}
        assert {(r.split_a, r.split_b): (r.matched_pairs, r.items_a, r.items_b) for r in cu.leakage_summary(df, distance).collect()} == want
    with pytest.raises(ValueError):
        cu.require_no_leakage(cu.split_leakage(df, 0))


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (3, 0)], "y_true int, y_pred int")
    rows = {r.label: r for r in ev.report(df).collect()}
    assert rows["1"].precision == pytest.approx(1 / 3) and rows["1"].recall == 1 and rows["3"].f1 == 0
    assert rows["accuracy"].f1 == pytest.approx(0.5) and rows["weighted avg"].support == 6
    cells = {r.y_true: r for r in ev.confusion(df, [0, 1, 2, 3]).collect()}
    assert (cells[2]["1"], cells[3]["3"]) == (1, 0)
    history = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "epoch int, f1 double")
    assert ev.best_epoch(history, "f1").first().epoch == 2
    log = spark.createDataFrame([(1.0, None, None), (None, 0.2, None), (None, None, 9.0)], "loss double, eval_loss double, train_runtime double")
    assert sorted(r.kind for r in ev.log_kinds(log).collect()) == ["evaluation", "step", "summary"]


def test_rotation_ties_take_the_first_angle(spark):
    df = spark.createDataFrame([("a", a, [1.0, 1.0, 0.0, 0.0]) for a in (270, 0, 90, 180)], "image_id string, angle int, logits array<double>")
    row = ro.rotation_log(ro.rotation_scores(df)).first()
    assert row.best_rotation_angle == 0 and row.pred_class_rot90 == 0 and row.status == "suspect"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
def test_manifest_holds_the_originals_of_all_splits(spark):
    ids = [r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()]
    want = collections.Counter(cu.SPLITS[i % 3] for i in ids)
    rows = registry.queries()["manifest_union"](spark, DIR).collect()
    assert collections.Counter(r.split_name for r in rows if r.row_type == "original") == want
    assert {r.split_name for r in rows if r.row_type == "augmented"} == {"train"}
    report = registry.queries()["curation_report"](spark, DIR).first()
    made = collections.Counter(r.split_name for r in rows)
    assert {x["split_name"]: x["images"] for x in json.loads(report.splits)} == dict(made) and report.total == len(rows)
