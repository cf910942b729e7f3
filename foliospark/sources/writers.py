"""Sinks: routed images, label files, logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import yolo_fields, yolo_line
from ..functions.text import LATEX


def mode_of(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_routed(rows: DataFrame, path: str, by: tuple[str, ...] = ("status",), overwrite: bool = False) -> None:
    """Parquet partitioned by outcome, so that each outcome is a folder."""
    rows.write.mode(mode_of(overwrite)).partitionBy(*by).parquet(path)


def write_csv_log(rows: DataFrame, path: str, order: str | None = None, overwrite: bool = False) -> None:
    (rows.orderBy(order) if order else rows).write.mode(mode_of(overwrite)).option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines; letters beyond ASCII stay as they are."""
    rows.write.mode(mode_of(overwrite)).json(path)


def write_yolo(boxes: DataFrame, path: str, overwrite: bool = False) -> None:
    """Label text per image (a folder each). Confidence is not part of the format."""
    fields = yolo_fields(("x1", "y1", "x2", "y2"), F.col("width"), F.col("height"))
    lines = boxes.select("image_id", yolo_line(F.col("cls_id"), fields).alias("value"))
    lines.write.mode(mode_of(overwrite)).partitionBy("image_id").text(path)


def final_only(rows: DataFrame, final: tuple[str, ...], save_intermediate: bool) -> DataFrame:
    """All columns, or just the final ones."""
    return rows if save_intermediate else rows.select(*final)


def latex_table(rows: list[tuple], header: tuple[str, ...]) -> str:
    """A small table as LaTeX source, cells escaped."""

    def cell(value: object) -> str:
        text = str(value)
        for sign, written in LATEX:
            text = text.replace(sign, written)
        return text

    lines = [" & ".join(map(cell, r)) + r" \\" for r in (header, *rows)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(header) + "}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}"])
