"""Spreadsheets as rows of cells: blank rows, counts and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim


def filled(cells: Column) -> Column:
    """Whether a row of cells has one that isn't blank."""
    return F.exists(cells, lambda c: F.coalesce(js_trim(c), F.lit("")) != "")


def sheet_texts(rows: DataFrame) -> DataFrame:
    """(file_id, sheet_index, sheet, text, n_rows, n_cells) of rows (file_id, sheet_index, sheet, row_index, cells) that aren't blank; sheets without one have empty text."""
    kept = F.when(filled(F.col("cells")), F.struct("row_index", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "\t").alias("t"), F.size("cells").alias("n")))
    listed = rows.groupBy("file_id", "sheet_index", "sheet").agg(F.array_sort(F.collect_list(kept)).alias("r"))
    return listed.select(
        "file_id",
        "sheet_index",
        "sheet",
        F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("text"),
        F.size("r").cast("long").alias("n_rows"),
        F.aggregate("r", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_cells"),
    )


def workbook_texts(sheets: DataFrame) -> DataFrame:
    """(file_id, sheet_count, total_cells, summary, text) of sheet_texts."""
    book = sheets.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("sheet_index", "sheet", "text"))).alias("s"), F.count("*").alias("sheet_count"), F.sum("n_cells").alias("total_cells")
    )
    summary = F.concat(F.lit("Planilha Excel com "), F.col("sheet_count").cast("string"), F.lit(" aba(s): "), F.array_join(F.transform("s", lambda x: x["sheet"]), ", "))
    head = F.concat(
        F.lit("=== ARQUIVO EXCEL ===\nResumo: "),
        F.col("summary"),
        F.lit("\nTotal de abas: "),
        F.col("sheet_count").cast("string"),
        F.lit("\nTotal de células: "),
        F.col("total_cells").cast("string"),
        F.lit("\n\n"),
    )
    body = F.transform("s", lambda x, i: F.concat(F.lit("=== ABA "), (i + 1).cast("string"), F.lit(": "), x["sheet"], F.lit(" ===\n"), x["text"], F.lit("\n\n")))
    return book.withColumn("summary", summary).select("file_id", "sheet_count", "total_cells", "summary", F.concat(head, F.array_join(body, "")).alias("text"))
