"""Pages of PDF files as DataFrames: the spine of pages, counts, OCR decisions, chunks, budgets, and merged text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Limits
from ..functions.quality import PAGE_CLASSES, ocr_bypass
from ..functions.text import js_length, js_trim, sanitize


def page_spine(files: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each page 1..total_pages of files (file_id, total_pages), with the extracted page's columns or those of an empty page."""
    spine = files.where("total_pages > 0").select("file_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total_pages").cast("long"))).alias("page_number"))
    return spine.join(pages, ["file_id", "page_number"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def with_visuals(pages: DataFrame, images: DataFrame, tables: DataFrame) -> DataFrame:
    """pages with image and table counts, 0 where unknown, and whether there is anything to see. images and tables have a row for a page at most."""
    keys = ["file_id", "page_number"]
    counted = pages.join(images, keys, "left").join(tables, keys, "left")
    counted = counted.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("embedded_image_count", "table_count")})
    return counted.withColumn("has_visual_content", (F.col("embedded_image_count") > 0) | (F.col("table_count") > 0))


def should_ocr(diag: Column, visual: Column) -> Column:
    return visual | (~diag["should_skip_ocr"] & (~diag["is_high_quality"] | diag["has_ocr_indicators"]))


def ocr_reason(diag: Column, visual: Column) -> Column:
    needs = F.when(diag["has_ocr_indicators"], "ocr-indicators").otherwise("insufficient-native-text")
    stays = F.when(diag["should_skip_ocr"], "quality-analysis-skip").otherwise("native-text-sufficient")
    return F.when(visual, "visual-content").when(should_ocr(diag, visual), needs).otherwise(stays)


def page_histogram(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages of each class, 0 where there is none."""
    kind = F.col("diag.classification")
    return pages.groupBy(*keys).agg(*[F.count_if(kind == c).alias("n_" + c.replace("-", "_")) for c in PAGE_CLASSES])


def page_counts(pages: DataFrame, *keys: str) -> DataFrame:
    return pages.groupBy(*keys).agg(
        F.count("*").alias("total_pages"),
        F.count_if("should_ocr").alias("ocr_pages"),
        F.count_if(~F.col("should_ocr")).alias("native_pages"),
        F.count_if("has_visual_content").alias("visual_pages"),
        F.count_if(F.col("embedded_image_count") > 0).alias("pages_with_images"),
        F.count_if(F.col("table_count") > 0).alias("pages_with_tables"),
    )


def selected_chunks(selected: DataFrame, per_chunk: int = Limits.ocr_pages_per_chunk) -> DataFrame:
    """(file_id, first, last): runs of consecutive selected pages, none of more than per_chunk. Pages below 1 and repeats don't count."""
    order = Window.partitionBy("file_id").orderBy("page_number")
    own = selected.select("file_id", F.col("page_number").cast("long").alias("page_number")).where("page_number >= 1").distinct()
    island = own.withColumn("island", F.col("page_number") - F.row_number().over(order))
    first = F.min("page_number").over(Window.partitionBy("file_id", "island"))
    bucket = island.withColumn("bucket", F.floor((F.col("page_number") - first) / per_chunk))
    return bucket.groupBy("file_id", "island", "bucket").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last")).select("file_id", "first", "last")


def probed_pages(selected: DataFrame, probes: DataFrame) -> DataFrame:
    """The selected pages that a probe of the file (file_id, valid, page_count) knows of: none of a file that it finds invalid."""
    return selected.join(probes.where("valid").select("file_id", "page_count"), "file_id").where(F.col("page_number") <= F.col("page_count")).drop("page_count")


def full_chunks(files: DataFrame, workers: int, most: int = 50) -> DataFrame:
    """(file_id, first, last): all pages in chunks of equal size, about two for each worker, of 1 to most pages."""
    total = F.col("total_pages").cast("int")
    size = F.least(F.greatest(F.ceil(total / (2 * workers)).cast("int"), F.lit(1)), F.lit(most)) if workers > 0 else F.lit(most)
    begun = files.where("total_pages > 0").withColumn("size", size).withColumn("i", F.explode(F.sequence(F.lit(0), total - 1, F.col("size"))))
    return begun.select("file_id", (F.col("i") + 1).cast("long").alias("first"), F.least(F.col("i") + F.col("size"), total).cast("long").alias("last"))


def chunk_pages(chunks: DataFrame) -> DataFrame:
    """The pages of chunks: the range join as an equi-join key, page i of a chunk being first + i."""
    return chunks.select("file_id", "first", "last", F.posexplode(F.sequence("first", "last")).alias("ordinal", "page_number"))


def page_limit_error(total_pages: Column, most: int = Limits.max_pdf_pages) -> Column:
    message = F.concat(F.lit("PDF possui "), total_pages.cast("string"), F.lit(f" páginas, acima do limite configurado de {most}."))
    return F.when((F.lit(most) > 0) & (total_pages > most), message)


def direct_ocr(total_pages: Column, text: Column, limits: Limits = Limits()) -> Column:
    """Whether a small document with hardly any native text goes to OCR as a whole."""
    per_page = js_length(js_trim(text)) / F.greatest(total_pages, F.lit(1))
    return (total_pages > 0) & (total_pages <= limits.direct_ocr_max_pages) & (per_page < limits.direct_ocr_chars_per_page)


def legacy_decision(quality: Column, total_pages: Column, n_bytes: Column, limits: Limits = Limits()) -> Column:
    """struct of decision (native or ocr) and reason for a document that isn't looked at page by page."""
    bypass = ocr_bypass(quality, total_pages)
    per_page = n_bytes / F.greatest(total_pages, F.lit(1))
    reason = (
        F.when(total_pages == 0, "no-pages")
        .when(total_pages <= limits.ocr_always_pages, "always-ocr")
        .when(~bypass["skip"], "insufficient-text")
        .when(bypass["strong"] & quality["has_ocr_indicators"], F.when(per_page > limits.bytes_per_page, "looks-scanned").otherwise("filesize-validated"))
        .when(bypass["strong"], "strong-direct-text")
        .otherwise("quality-analysis")
    )
    needs = reason.isin("always-ocr", "insufficient-text", "looks-scanned")
    return F.struct(F.when(needs, "ocr").otherwise("native").alias("decision"), reason.alias("reason"))


def reserve_pages(requests: DataFrame, budget: int, key: str = "job_id", order: str = "file_order", pages: str = "ocr_pages") -> DataFrame:
    """(key, order, pages, accepted, remaining): requests in order take pages of a job's budget. One that doesn't fit takes
    nothing, and a later, smaller one may fit; so this is a fold over a job's requests and not a running sum.

    The fold runs over rows that are sorted by job and order, batch after batch: all that is held is the job's count so far, whatever its
    number of requests. Of equal orders the one with fewer pages comes first; null pages are none. A budget of 0 is no limit.
    """
    own = requests.select(key, order, F.coalesce(F.col(pages).cast("long"), F.lit(0)).alias(pages))
    sorted_ = own.repartition(key).sortWithinPartitions(key, order, pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, used, begun = None, 0, False
        for batch in batches:
            accepted, remaining = [], []
            for k, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or k != job:
                    job, used, begun = k, 0, True
                fits = budget <= 0 or used + n <= budget
                used += n if fits else 0
                accepted.append(fits)
                remaining.append(max(budget - used, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted), pa.array(remaining, pa.int64())], names=[key, order, pages, "accepted", "remaining"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return sorted_.mapInArrow(run, f"{kinds}, accepted boolean, remaining long")


def pages_limit_error(pages: Column, most: int = Limits.max_ocr_pages_per_pdf) -> Column:
    message = F.concat(F.lit("PDF requer OCR em "), pages.cast("string"), F.lit(f" páginas, acima do limite configurado de {most}."))
    return F.when((F.lit(most) > 0) & (pages > most), message)


def budget_error(pages: Column, remaining: Column, accepted: Column) -> Column:
    message = F.concat(F.lit("PDF requer OCR em "), pages.cast("string"), F.lit(" páginas, mas restam "), remaining.cast("string"), F.lit(" páginas de OCR no limite deste job."))
    return F.when(~accepted, message)


def ordered_text(df: DataFrame, keys: list[str], order: str, text: str, separator: str) -> DataFrame:
    """Texts of each group put together in order; blank ones are left out."""
    parts = F.array_sort(F.collect_list(F.when(js_trim(F.col(text)) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias("text"))


def ocr_overlay(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """pages with their text replaced by the OCR text (file_id, page_number, ocr_text) where that isn't blank."""
    text = F.coalesce(F.when(js_trim(F.col("ocr_text")) != "", js_trim(F.col("ocr_text"))), F.col("text"))
    return pages.join(ocr, ["file_id", "page_number"], "left").withColumn("text", text).drop("ocr_text")


def mixed_result(native: Column, merged: Column, ocr_pages: Column, ocr_error: Column) -> Column:
    """struct of value and error of a file looked at page by page: an error of OCR counts only where pages were selected, and then the whole
    native text stands, or the error where that is blank; else it is the pages' merged text."""
    failed = (ocr_pages > 0) & ocr_error.isNotNull()
    has_native = js_trim(native) != ""
    value = F.when(failed, F.when(has_native, sanitize(js_trim(native)))).otherwise(sanitize(merged))
    return F.struct(value.alias("value"), F.when(failed & ~has_native, ocr_error).alias("error"))


def ocr_fallback(native: Column, ocr_text: Column, ocr_error: Column) -> Column:
    """struct of value and error: OCR text, or native text where OCR failed or found nothing; an error only where neither has text."""
    has_native = js_trim(native) != ""
    value = F.when(ocr_error.isNotNull(), F.when(has_native, sanitize(native))).when((js_trim(ocr_text) == "") & has_native, sanitize(native)).otherwise(sanitize(ocr_text))
    return F.struct(value.alias("value"), F.when(ocr_error.isNotNull() & ~has_native, ocr_error).alias("error"))
