"""Dataset curation: near-duplicate images, leakage between splits, class balance, manifest."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import hamming, imbalance, imbalance_advice, required_rotation
from ..functions.text import document_id
from ..storage import store
from .least_used import STRETCH, least_used

SPLITS = ("train", "valid", "test")
#: Bits of a hash.
BITS = 64
#: Hashes that agree in their bands and are compared one with another; more are divided by narrower bands.
MOST_COMPARED = 64
#: Combinations of bands that a hash may be filed under.
MOST_MASKS = 1000


def _masks(bands: int, distance: int) -> list[int]:
    """The bits of all but distance of the bands, for each choice of those: hashes within the distance agree in one of the masks."""
    cuts = [round(BITS * i / bands) for i in range(bands + 1)]
    band = [sum(1 << k for k in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [signed(sum(kept)) for kept in combinations(band, bands - distance)]


def hash_pairs(records: DataFrame, distance: int, hash_col: str = "canonical_hash_int") -> DataFrame:
    """Pairs of distinct hashes within a Hamming distance of 1 or more: hash_a < hash_b, hamming_distance.

    Equal hashes are one entry beforehand, so copies multiply nothing. Of
    distance + 1 bands of bits two near hashes share one; of more and narrower
    bands all but distance (pigeonhole). Where many hashes agree in a band, as
    those of blank pages do, these hashes are filed again by narrower bands, of
    which they must share several: more bits select them. That ends where
    filing would make more rows than comparing. For large distances bands hardly
    select.
    """
    steps = [b for b in (distance + (1 << k) for k in range(7)) if b <= BITS and comb(b, distance) <= MOST_MASKS] or [distance + 1]
    loose, found = store(records.select(F.col(hash_col).cast("long").alias("h")).where("h IS NOT NULL").distinct(), "hashes"), []
    for bands, narrower in zip(steps, [*steps[1:], None]):
        filed = loose.select("h", F.explode(F.array(*map(F.lit, _masks(bands, distance)))).alias("mask")).withColumn("bits", F.col("h").bitwiseAND(F.col("mask")))
        few = filed
        if narrower:
            most = max(MOST_COMPARED, 2 * comb(narrower, distance))
            crowded = store(filed.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mask", "bits"), "crowded")
            if crowded.isEmpty():
                narrower = None
            else:
                few = filed.join(crowded, ["mask", "bits"], "left_anti")
        other = few.select("mask", "bits", F.col("h").alias("o"))  # made of few bytes, but of many rows: not to be broadcast
        apart = hamming(F.col("h"), F.col("o"))
        near = few.hint("merge").join(other, ["mask", "bits"]).where((F.col("h") < F.col("o")) & (apart <= distance))
        found.append(near.select(F.col("h").alias("hash_a"), F.col("o").alias("hash_b"), apart.alias("hamming_distance")))
        if not narrower:
            break
        loose = store(filed.join(crowded, ["mask", "bits"], "left_semi").select("h").distinct(), "hashes")
    return reduce(DataFrame.unionByName, found).distinct()


def _within(a: DataFrame, b: DataFrame, records: DataFrame, distance: int, hash_col: str) -> DataFrame:
    """a (hash_a, ...) and b (hash_b, ...) within the distance: equal hashes by one join, others over the near hashes."""
    same = a.join(b, F.col("hash_a") == F.col("hash_b")).withColumn("hamming_distance", F.lit(0))
    if not distance:
        return same
    near = hash_pairs(records, distance, hash_col)
    both = near.unionByName(near.select(F.col("hash_b").alias("hash_a"), F.col("hash_a").alias("hash_b"), "hamming_distance"))
    return same.unionByName(a.join(both, "hash_a").join(b, "hash_b").select(same.columns))


def near_pairs(records: DataFrame, distance: int, id_col: str = "record_id", hash_col: str = "canonical_hash_int") -> DataFrame:
    """Every pair of records within the distance, record_a < record_b, equal hashes included. Copies give all their pairs: document_groups and leakage_summary need none of them."""
    side = lambda t: records.select(F.col(id_col).alias(f"record_{t}"), F.col(hash_col).alias(f"hash_{t}"))
    return _within(side("a"), side("b"), records, distance, hash_col).where("record_a < record_b").select("record_a", "record_b", "hamming_distance")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b); nodes without edges are their own.

    Labels go to neighbours and then to their label's label, so rounds grow
    with the logarithm of the longest chain; each round is stored. It ends when
    no label changes, which it must, as labels only ever fall.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = store(both, "edges")
    labels, changed = nodes.select("node", F.col("node").alias("label")).distinct(), True
    while changed:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("near"))
        hop = told.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = store(told.join(hop, "near", "left").select("node", F.coalesce("far", "near").alias("next"), "label"), "labels")
        changed = not new.where("next <> label").isEmpty()
        labels = new.select("node", F.col("next").alias("label"))
    return labels.withColumnRenamed("label", "component")


def document_groups(records: DataFrame, distance: int = 0, hash_col: str = "canonical_hash_int", order_col: str = "record_id", within: list[str] = []) -> DataFrame:
    """Records with document_group_id doc_000000, ..., numbered by their first record.

    At distance 0 groups are equal hashes, each value of the columns within by
    itself; beyond, what near hashes connect. A record without a hash is a
    group of its own. The numbers come from a rank over the groups, not over
    the records.
    """
    if distance and within:
        raise ValueError("near hashes are grouped over all records")
    alone = F.concat(F.lit("#"), F.col(order_col).cast("string"))
    if distance == 0:
        keyed = records.withColumn("group_key", F.coalesce(F.col(hash_col).cast("string"), alone))
    else:
        nodes = records.select(F.col(hash_col).alias("node")).where("node IS NOT NULL").distinct()
        near = hash_pairs(records, distance, hash_col).select(F.col("hash_a").alias("a"), F.col("hash_b").alias("b"))
        keyed = records.join(components(near, nodes), F.col(hash_col) == F.col("node"), "left").withColumn("group_key", F.coalesce(F.col("component").cast("string"), alone)).drop("node", "component")
    first = keyed.groupBy(*within, "group_key").agg(F.min(order_col).alias("first"))
    numbered = number_rows(first, ["first"], within).select(*within, "group_key", document_id(F.col("number")).alias("document_group_id"))
    return keyed.join(numbered, [*within, "group_key"]).drop("group_key").select(*records.columns, "document_group_id")


def number_rows(rows: DataFrame, order: list[str], by: list[str] = []) -> DataFrame:
    """Add number from 0 in the given order, inside each key of by.

    No task holds all rows of a key: rows are dealt in ranges, ranked inside
    their range, and the sizes of the ranges before are added. The ranges are
    stored once, as Spark would sample others for each use of them.
    """
    part = F.spark_partition_id().alias("__part")
    ranged = store(rows.repartitionByRange(*by, *order).select("*", part), "ranges")
    keys = ["__part", *by]
    sizes = ranged.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")).drop("__n")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    ranked = ranged.withColumn("__within", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = ranked.alias("r").join(before.alias("s"), reduce(Column.__and__, same))
    return joined.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("s.__before") + F.col("r.__within") - 1).cast("long").alias("number"))


def split_leakage(records: DataFrame, distance: int = 2, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Every near pair across splits once, the earlier split first; leakage_summary counts them without listing."""
    place = F.array_position(F.array(*map(F.lit, splits)), F.col("split_name"))
    side = lambda t: records.select(place.alias(f"place_{t}"), F.col("split_name").alias(f"split_{t}"), F.col("record_id").alias(f"record_id_{t}"), F.col("class_name").alias(f"class_{t}"), F.col("path").alias(f"path_{t}"), F.col("canonical_hash_int").alias(f"hash_{t}"))
    return _within(side("a"), side("b"), records, distance, "canonical_hash_int").where("place_a < place_b").drop("place_a", "place_b")


def leakage_summary(records: DataFrame, distance: int = 2, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """Per two splits the number of near pairs and of records in them: split_a, split_b, matched_pairs, items_a, items_b.

    Pairs are counted from the number of records of each hash in each split;
    a million copies of one image are one row, not a million times as many.
    """
    place = F.array_position(F.array(*map(F.lit, splits)), F.col("split_name"))
    sizes = records.where("canonical_hash_int IS NOT NULL").groupBy("split_name", place.alias("place"), F.col("canonical_hash_int").alias("hash")).agg(F.count("*").alias("n"))
    sizes = store(sizes, "sizes")
    side = lambda t: sizes.select(*(F.col(c).alias(f"{c}_{t}") for c in sizes.columns))
    met = _within(side("a"), side("b"), records, distance, "canonical_hash_int").where("place_a < place_b")
    met = met.select("split_name_a", "split_name_b", "hash_a", "hash_b", "n_a", "n_b")
    pair = [F.col("split_name_a").alias("split_a"), F.col("split_name_b").alias("split_b")]
    a = met.groupBy(*pair, "hash_a").agg(F.first("n_a").alias("n"), F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"))
    b = met.groupBy(*pair, "hash_b").agg(F.first("n_b").alias("n"))
    total = a.groupBy("split_a", "split_b").agg(F.sum("pairs").alias("matched_pairs"), F.sum("n").alias("items_a"))
    return total.join(b.groupBy("split_a", "split_b").agg(F.sum("n").alias("items_b")), ["split_a", "split_b"])


def require_no_leakage(pairs: DataFrame) -> DataFrame:
    """The pairs, if there are none; else an error that names a few."""
    found = pairs.select("record_id_a", "record_id_b").limit(5).collect()
    if found:
        raise ValueError(f"near-duplicates across splits, for example {[tuple(r) for r in found]}")
    return pairs


def class_counts(records: DataFrame, classes: DataFrame, class_col: str = "class_name") -> DataFrame:
    """Count of every class in the dimension, empty ones included, its percentage, the imbalance and advice."""
    counts = classes.join(records.groupBy(class_col).agg(F.count("*").alias("n")), class_col, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    every = Window.partitionBy()  # over the classes, of which there are few
    ratio = imbalance(F.max("n").over(every), F.min("n").over(every))
    total = F.sum("n").over(every)
    return counts.withColumns({"percentage": F.when(total > 0, 100.0 * F.col("n") / total).otherwise(0.0), "ratio": ratio, "advice": imbalance_advice(ratio)})


def class_needs(records: DataFrame, classes: DataFrame, class_col: str = "class_name") -> DataFrame:
    """How many images each class lacks to the largest."""
    counts = class_counts(records, classes, class_col).select(class_col, "n")
    return counts.withColumn("need", F.max("n").over(Window.partitionBy()) - F.col("n"))


def unexpected_and_missing(seen: DataFrame, expected: DataFrame, name: str = "class_name") -> DataFrame:
    """Classes that should not be there, and expected ones that are not."""
    values = seen.select(name).distinct()
    extra = values.join(expected, name, "left_anti").withColumn("status", F.lit("unexpected"))
    return extra.unionByName(expected.select(name).distinct().join(values, name, "left_anti").withColumn("status", F.lit("missing")))


def balance(records: DataFrame, classes: DataFrame, seed: int = 42, stretch: int = STRETCH) -> DataFrame:
    """Pick source records so that every class reaches the largest.

    For each target class as many document groups as it lacks, in an order of
    hashes of seed, target and group; each group at most once per target, from
    its first record of the other class that the groups before it in that
    order used least for this target (the first by name on ties). The picks are
    those of one walk through the order, though no task makes it. Classes are a
    handful. Raises where a target has fewer eligible groups than it lacks.
    """
    needs = {r["class_name"]: r["need"] for r in class_needs(records, classes).where("need > 0").collect()}
    first = records.groupBy("document_group_id", "class_name").agg(F.min(F.struct("record_id", "path", "canonical_hash_hex")).alias("record"))
    groups = first.groupBy("document_group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "record")))).alias("held"))
    target = F.explode(F.array(*(F.struct(F.lit(c).alias("target_class"), F.lit(n).alias("need")) for c, n in sorted(needs.items()))) if needs else F.expr("cast(array() AS array<struct<target_class:string,need:bigint>>)"))
    names = sorted(r["class_name"] for r in classes.select("class_name").distinct().collect())
    options = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.map_contains_key("held", F.array(*map(F.lit, names))[k]) & (F.array(*map(F.lit, names))[k] != F.col("target_class")))
    eligible = groups.select("document_group_id", "held", target.alias("t")).select("document_group_id", "held", "t.*").withColumn("options", options).where(F.size("options") > 0)
    turn = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), "target_class", "document_group_id"))
    picked = store(number_rows(eligible.withColumn("turn", turn), ["turn", "document_group_id"], ["target_class"]).where("number < need"), "picked")
    have = {r["target_class"]: r["n"] for r in picked.groupBy("target_class").agg(F.count("*").alias("n")).collect()}
    if lacking := [c for c in sorted(needs) if have.get(c, 0) < needs[c]]:
        raise ValueError(f"not enough document groups for {lacking}")
    choice = least_used(picked.select(F.col("target_class").alias("target"), "number", "options"), len(names), stretch)
    chosen = picked.join(choice.withColumnRenamed("target", "target_class"), ["target_class", "number"])
    chosen = chosen.withColumn("source_class", F.array(*map(F.lit, names))[F.col("choice")]).withColumn("record", F.expr("held[source_class]"))
    rotation = required_rotation(F.col("source_class").cast("int"), F.col("target_class").cast("int"))
    return chosen.select("target_class", "source_class", "document_group_id", "record.*", rotation.alias("rotation_applied"))


def manifest(records: DataFrame, picks: DataFrame) -> DataFrame:
    """All kept originals and all augmentations, in one table."""
    original = records.select(F.lit("original").alias("row_type"), "split_name", F.col("class_name").alias("target_class"), F.col("class_name").alias("source_class"), F.lit(0).alias("rotation_applied"), F.col("path").alias("source_path"), F.concat_ws("/", "split_name", "class_name", F.format_string("orig_%s", "record_id")).alias("output_path"), "record_id", "document_group_id", "canonical_hash_hex")
    made = picks.select(F.lit("augmented").alias("row_type"), F.lit("train").alias("split_name"), "target_class", "source_class", "rotation_applied", F.col("path").alias("source_path"), F.concat_ws("/", F.lit("train"), "target_class", F.format_string("aug_target_%s_from_%s_%s", "target_class", "source_class", "record_id")).alias("output_path"), "record_id", "document_group_id", "canonical_hash_hex")
    return original.unionByName(made)


def curation_report(rows: DataFrame) -> DataFrame:
    """One nested row over a manifest: counts per split and class, documents per split, augmentations."""
    split = rows.groupBy("split_name").agg(F.count("*").alias("images"), F.count_distinct("document_group_id").alias("documents"), F.count_if(F.col("row_type") == "augmented").alias("augmented"))
    per_class = rows.groupBy("split_name", "target_class").agg(F.count("*").alias("n")).groupBy("split_name").agg(F.array_sort(F.collect_list(F.struct("target_class", "n"))).alias("classes"))
    return split.join(per_class, "split_name").agg(F.array_sort(F.collect_list(F.struct("split_name", "images", "documents", "augmented", "classes"))).alias("splits"), F.sum("images").alias("total"))
