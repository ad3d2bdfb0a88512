"""Writers of reports and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame

REPORT_COLUMNS = ["category", "auroc_px", "f1_px", "ap_px", "aupro", "auroc_sp", "f1_sp", "ap_sp"]


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """The report's rows in the fixed column order, categories first and their mean last, as one small file."""
    rows = report.select(*REPORT_COLUMNS).orderBy(report["category"] == "mean", "category").coalesce(1)
    (rows.write.option("header", "true") if fmt == "csv" else rows.write).format(fmt).mode("overwrite").save(path)


def write_maps(pixels: DataFrame, path: str) -> None:
    """Maps or masks, a folder per category and anomaly type."""
    pixels.write.mode("overwrite").partitionBy("category", "anomaly_type").parquet(path)
