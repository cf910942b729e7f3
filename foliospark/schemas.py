"""Labels, thresholds and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The 37 labels in the order of their ids.
LABELS = (
    "ADDR", "ADDR_PREFIX", "AMOUNT", "AMOUNT_PREFIX", "BILLID", "BILLID_PREFIX", "CASHIER", "CASHIER_PREFIX", "DATETIME",
    "DATETIME_PREFIX", "FPRICE", "FPRICE_PREFIX", "OTHER", "PHONE", "PHONE_PREFIX", "PRODUCT_NAME", "PRODUCT_NAME_PREFIX", "RECEMONEY",
    "RECEMONEY_PREFIX", "REMAMONEY", "REMAMONEY_PREFIX", "SHOP_NAME", "SUB_TPRICE", "SUB_TPRICE_PREFIX", "TAMOUNT", "TAMOUNT_PREFIX", "TDISCOUNT",
    "TDISCOUNT_PREFIX", "TITLE", "TPRICE", "TPRICE_PREFIX", "UDISCOUNT", "UDISCOUNT_PREFIX", "UNIT", "UNIT_PREFIX", "UPRICE", "UPRICE_PREFIX",
)
# Groups of fields in the order in which reports show them.
FIELD_GROUPS = {
    "Store information": ("SHOP_NAME", "ADDR", "PHONE"),
    "Receipt metadata": ("BILLID", "DATETIME", "CASHIER", "TITLE"),
    "Product information": ("PRODUCT_NAME", "AMOUNT", "UNIT", "UPRICE", "FPRICE", "TPRICE"),
    "Payment summary": ("SUB_TPRICE", "TAMOUNT", "TDISCOUNT", "UDISCOUNT", "RECEMONEY", "REMAMONEY"),
}
# The labels that an extraction keeps by default.
ALLOWED = ("SHOP_NAME", "ADDR", "DATETIME", "TPRICE", "PRODUCT_NAME", "AMOUNT", "UPRICE", "SUB_TPRICE", "UDISCOUNT")
OTHER = "OTHER"
OTHER_FIELDS = "Other fields"
OTHER_ID = LABELS.index(OTHER)
MIN_SCORE = 0.50
DETECTOR_CONF, SEGMENT_CONF, NMS_IOU = 0.08, 0.5, 0.45

OCR_SCHEMA = "image string, size struct<width:bigint,height:bigint>, bboxes array<array<bigint>>, bboxes_norm array<array<bigint>>, class_ids array<bigint>, tokens array<string>"
RECORD_SCHEMA = "record_id string, split_name string, class_name string, angle int, path string, canonical_hash_int long, canonical_hash_hex string"


def label_table(spark: SparkSession, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """label_id, label, is_prefix, base_label, field_group, group_pos, field_pos: as many rows as labels."""
    place = {f: (g, i, j) for i, (g, fields) in enumerate(FIELD_GROUPS.items()) for j, f in enumerate(fields)}
    rows = [(i, x, x.endswith("_PREFIX"), x.removesuffix("_PREFIX"), *place.get(x.removesuffix("_PREFIX"), (OTHER_FIELDS, len(FIELD_GROUPS), 0))) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "label_id int, label string, is_prefix boolean, base_label string, field_group string, group_pos int, field_pos int")
