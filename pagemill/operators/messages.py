"""Messages and their files: validation, routing, limits, text blocks, and the response."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..functions.text import js_length, js_trim, sanitize_text
from ..functions.urls import URL, basename

#: Extractors by the part of a MIME type after its first slash. Fixed values.
ROUTES = {
    "plain": "txt",
    "pdf": "pdf",
    "jpeg": "image",
    "jpg": "image",
    "png": "image",
    "vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "msword": "doc",
    "vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "vnd.ms-excel": "xlsx",
}
#: Audio types that a transcription accepts, and its size limit. Fixed values.
AUDIO_TYPES = ("audio/webm", "audio/mpeg", "audio/mp3", "audio/wav", "audio/ogg", "audio/m4a", "audio/mp4")
MAX_AUDIO_BYTES = 50 * 1024 * 1024
#: Seconds that an extractor may take. Fixed values.
TIMEOUT_SECONDS = {"txt": 10, "image": 45, "docx": 20, "doc": 20, "xlsx": 20, "pdf": 600, "audio": 120}
FILE_SEPARATOR = "\n\n---\n\n"
FILE_STRUCT = "struct<fileId:string,url:string,mimeType:string>"
MESSAGE_SCHEMA = f"conversationId string, body struct<files:array<{FILE_STRUCT}>>, _corrupt_record string"


def mime_key(mime: Column) -> Column:
    """What follows the first slash, up to a second one; 'undefined' without a slash."""
    parts = F.split(mime, "/")
    return F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("undefined"))


def route(mime: Column) -> Column:
    """struct of extractor and error. The major type counts for audio alone, as sent; case counts."""
    key = mime_key(mime)
    extractor = F.when(mime.startswith("audio/"), "audio")
    for k, name in ROUTES.items():
        extractor = extractor.when(key == k, name)
    return F.struct(extractor.alias("extractor"), F.when(extractor.isNull(), F.concat(F.lit("Unsupported file type: "), key)).alias("error"))


def validated(messages: DataFrame) -> DataFrame:
    """messages (conversationId, body) with issues: an array that is empty for a valid message."""
    files = F.coalesce(F.col("body.files"), F.array().cast(f"array<{FILE_STRUCT}>"))
    parsed = F.when(F.col("_corrupt_record").isNotNull(), "body: invalid JSON") if "_corrupt_record" in messages.columns else F.lit(None).cast("string")
    of_files = F.flatten(
        F.transform(
            files,
            lambda f, i: F.array(
                F.when(f["fileId"].isNull(), F.concat(F.lit("files."), i.cast("string"), F.lit(".fileId: required"))),
                F.when(f["url"].isNull() | ~f["url"].rlike(URL), F.concat(F.lit("files."), i.cast("string"), F.lit(".url: invalid"))),
                F.when(f["mimeType"].isNull(), F.concat(F.lit("files."), i.cast("string"), F.lit(".mimeType: required"))),
            ),
        )
    )
    top = F.array(parsed, F.when(F.col("conversationId").isNull(), "conversationId: required"), F.when(F.col("body").isNull(), "body: required"))
    return messages.withColumn("issues", F.array_compact(F.concat(top, of_files)))


def exploded(messages: DataFrame) -> DataFrame:
    """(message_index, file_index, conversation_id, file_id, url, mime_type, n_files): one row for each file."""
    files = messages.select("message_index", F.col("conversationId").alias("conversation_id"), F.size("body.files").alias("n_files"), F.posexplode("body.files").alias("file_index", "f"))
    return files.select("message_index", "file_index", "conversation_id", F.col("f.fileId").alias("file_id"), F.col("f.url").alias("url"), F.col("f.mimeType").alias("mime_type"), "n_files")


def file_count_error(n_files: Column, most: int = Limits.max_files_per_message) -> Column:
    message = F.concat(F.lit("A requisição contém "), n_files.cast("string"), F.lit(f" arquivos, acima do limite configurado de {most}."))
    return F.when((F.lit(most) > 0) & (n_files > most), message)


def size_error(n_bytes: Column, most: int = Limits.max_file_bytes) -> Column:
    """The code for a file above the limit; only PDF files are held to it."""
    return F.when((F.lit(most) > 0) & (n_bytes > most), "FILE_LIMIT_EXCEEDED")


def download_error(status: Column, status_text: Column, failure: Column) -> Column:
    """What a file gets that couldn't be fetched: failure is the client's own error, which is also what it makes of a status of 500 or more. Fixed values."""
    return (
        F.when(failure.isNotNull(), F.concat(F.lit("Failed to fetch file: "), failure))
        .when(status >= 500, F.concat(F.lit("Failed to fetch file: Request failed with status code "), status.cast("string")))
        .when(status == 404, "Arquivo não encontrado no bucket. Verifique se o arquivo existe.")
        .when(status >= 400, F.concat(F.lit("Erro HTTP "), status.cast("string"), F.lit(": "), F.coalesce(status_text, F.lit(""))))
    )


def timeout_error(extractor: Column, limits: Mapping[str, float] = TIMEOUT_SECONDS) -> Column:
    """What a file gets whose extractor took too long; it says that the time limit was exceeded, so its job expires."""
    seconds = F.coalesce(*[F.when(extractor == k, f"{v:g}") for k, v in limits.items()], F.lit(None).cast("string"))
    return F.concat(F.lit("O processamento deste arquivo "), F.upper(extractor), F.lit(" excedeu o tempo limite de "), seconds, F.lit(" segundos."))


def file_block(url: Column, text: Column) -> Column:
    return F.concat(F.lit("## Transcricao do arquivo: "), basename(url), F.lit(":\n\n"), text)


def error_block(url: Column, code: Column, reason: Column) -> Column:
    """What the reader of a conversation is told about a file that failed. Fixed values."""
    advice = "Oriente o usuário a reduzir, dividir ou reenviar uma versão compatível do arquivo, se necessário."
    return F.concat(
        F.lit("## Transcricao do arquivo: "),
        basename(url),
        F.lit(":\n\n["),
        code,
        F.lit("]\nEste arquivo não foi processado integralmente.\nMotivo: "),
        reason,
        F.lit("\n" + advice),
    )


def assembled(files: DataFrame, run_ms: int, host: str, protocol: str = "https") -> DataFrame:
    """(conversation_id, text, filename, download_url, processed_files, failed_files) of files (conversation_id, message_index,
    file_index, file_id, url, value, error, code), blocks in input order."""
    block = F.when(F.col("error").isNull(), file_block(F.col("url"), F.col("value"))).otherwise(error_block(F.col("url"), F.coalesce("code", F.lit("FILE_PROCESSING_ERROR")), F.col("error")))
    row = F.struct("message_index", "file_index", "file_id", block.alias("block"), "error")
    listed = files.groupBy("conversation_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    name = F.concat(F.col("conversation_id"), F.lit(f"-{run_ms}.txt"))
    return listed.select(
        "conversation_id",
        sanitize_text(js_trim(F.array_join(F.transform("r", lambda x: x["block"]), FILE_SEPARATOR))).alias("text"),
        name.alias("filename"),
        F.concat(F.lit(f"{protocol}://{host}/texts/"), F.col("conversation_id"), F.lit("/"), name).alias("download_url"),
        F.transform(F.filter("r", lambda x: x["error"].isNull()), lambda x: x["file_id"]).alias("processed_files"),
        F.transform(F.filter("r", lambda x: x["error"].isNotNull()), lambda x: F.struct(x["file_id"].alias("fileId"), x["error"].alias("error"))).alias("failed_files"),
    )


def request_summary(messages: DataFrame, first: int = 5) -> DataFrame:
    """Of the first messages of each request: conversation, length of the content, number of files and their kinds."""
    files = F.coalesce(F.col("body.files"), F.array().cast(f"array<{FILE_STRUCT}>"))
    return messages.where(F.col("message_index") < first).select(
        "request_id",
        "message_index",
        F.col("conversationId").alias("conversation_id"),
        F.coalesce(js_length(F.col("content")), F.lit(0)).cast("long").alias("content_length"),
        F.size(files).cast("long").alias("files_count"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(files, lambda f: f["mimeType"]))), ",").alias("file_types"),
    )


def accepted_audio(mime: Column, n_bytes: Column) -> Column:
    return mime.isin(*AUDIO_TYPES) & (n_bytes <= MAX_AUDIO_BYTES)


def data_url(mime: Column, content: Column) -> Column:
    """An image as a data URL, in one line (Spark breaks what it encodes after 76 characters)."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def needs_token(path: Column, public: tuple[str, ...] = ("/texts", "/api/process-message", "/api-docs", "/favicon.ico")) -> Column:
    """Which token a request path asks for: jobs, none or main."""
    open_ = F.lit(False)
    for p in public:
        open_ = open_ | path.startswith(p)
    return F.when(path.startswith("/api/jobs"), "jobs").when(open_, "none").otherwise("main")
