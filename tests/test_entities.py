from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators import entities as en
from foliospark.schemas import label_table


def test_first_subtoken_ties_and_defaults(spark):
    flat = [0.0] * 37
    sure = [9.0 if k == 0 else 0.0 for k in range(37)]
    other = [9.0 if k == 21 else 0.0 for k in range(37)]
    tokens = spark.createDataFrame([("a", 0, None, sure), ("a", 1, 0, sure), ("a", 2, 0, other), ("a", 3, 1, flat)], "image_id string, token_idx int, word_id int, logits array<double>")
    words = spark.createDataFrame([("a", 0, " x "), ("a", 1, "  "), ("a", 2, "y"), ("a", 3, "cut")], "image_id string, box_idx int, text string")
    out = {r.box_idx: r for r in en.predictions_of_words(words, en.first_subtoken(en.score_tokens(tokens))).collect()}
    assert out[0].pred_id == 0 and out[0].score > 0.99
    assert (out[1].pred_id, out[1].score) == (12, 0.0)
    assert out[2].pred_id == 0 and abs(out[2].score - 1 / 37) < 1e-12  # first of equal logits
    assert (out[3].pred_id, out[3].score) == (12, 0.0)


def test_keep_join_and_report(spark):
    rows = [("a", 0, "ADDR", " 1 Main ", 0.5), ("a", 2, "ADDR", "Street", 0.9), ("a", 1, "SHOP_NAME", "Shop", 0.8), ("a", 3, "ADDR_PREFIX", "Addr:", 0.9), ("a", 4, "OTHER", "x", 0.9), ("a", 5, "TITLE", "T", 0.9), ("a", 6, "ADDR", "low", 0.49), ("a", 7, "PHONE_PREFIX", "Tel", 0.7)]
    df = spark.createDataFrame(rows, "image_id string, idx int, label string, text string, score double")
    kept = en.keep_entities(df)
    assert sorted(r.idx for r in kept.collect()) == [0, 1, 2]
    joined = {r.label: r.value for r in en.joined_by_label(kept).collect()}
    assert joined == {"ADDR": "1 Main Street", "SHOP_NAME": "Shop"}
    fields = {r.base: r for r in en.values_and_prefixes(df).collect()}
    assert fields["ADDR"].prefix == "Addr:" and abs(fields["ADDR"].confidence - 0.7) < 1e-9
    assert fields["PHONE"].value == "" and abs(fields["PHONE"].confidence - 0.7) < 1e-9
    report = [(r.field, r.prefix, r.value, r.conf) for r in en.report_rows(en.values_and_prefixes(df), label_table(spark)).orderBy("row").collect()]
    assert report == [("Store information", "", "", ""), ("SHOP_NAME", "-", "Shop", "0.80"), ("ADDR", "Addr:", "1 Main Street", "0.70"), ("PHONE", "Tel", "-", "0.70"), ("Receipt metadata", "", "", ""), ("TITLE", "-", "T", "0.90")]
    odd = spark.createDataFrame([("a", "ZZZ", "v", "", 0.5), ("a", "NEW", "w", "p", None), ("a", "ADDR", "x", "", 0.9)], "image_id string, base string, value string, prefix string, confidence double")
    assert [(r.field, r.value, r.conf) for r in en.report_rows(odd, label_table(spark)).orderBy("row").collect()] == [("Store information", "", ""), ("ADDR", "x", "0.90"), ("Other fields", "", ""), ("NEW", "w", "-"), ("ZZZ", "v", "0.50")]
    maps = en.entity_maps(kept).first()
    assert maps.entities == [{"ADDR": " 1 Main "}, {"SHOP_NAME": "Shop"}, {"ADDR": "Street"}]
    assert maps.joined == {"ADDR": "1 Main Street", "SHOP_NAME": "Shop"}


def test_text_functions(spark):
    df = spark.createDataFrame([("  ..a b/c--  ",), ("...",), ("x" * 50,)], "v string")
    assert [r[0] for r in df.select(t.safe_name(F.col("v"))).collect()] == ["a_b_c", "img", "x" * 40]
    one = spark.createDataFrame([("50% of {a_b}~",)], "v string")
    assert one.select(t.latex_escape(F.col("v"))).first()[0] == r"50\% of \{a\_b\}\textasciitilde{}"
    assert one.select(t.shorten(F.lit("abcdefgh"), 6)).first()[0] == "abc..."
    assert one.select(t.percent(F.lit(0.999))).first()[0] == 99
