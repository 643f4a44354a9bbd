"""Timers, perplexity and image paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptforge.functions.text import _col, image_key

# Fixed value: annotation images and the gallery live under this folder name.
ANNOTATION_FOLDER = "annotations"

# File extension -> MIME type, as Python's ``mimetypes`` maps the
# common image / page types; anything else is application/octet-stream.
MIME_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff",
    "svg": "image/svg+xml", "ico": "image/vnd.microsoft.icon", "html": "text/html", "htm": "text/html",
    "txt": "text/plain", "json": "application/json", "csv": "text/csv",
}
DEFAULT_MIME = "application/octet-stream"


def timer_averages(times: DataFrame, purpose: str = "purpose", seq: str = "seq",
                   elapsed: str = "elapsed") -> DataFrame:
    """A11 + A14: average time per purpose, purposes in first-seen order,
    -1 for a purpose that has no recorded time."""
    out = times.groupBy(purpose).agg(F.min(seq).alias("first_seq"), F.avg(elapsed).alias("_avg"))
    return out.select(F.col(purpose).alias("purpose"), "first_seq",
                      F.coalesce("_avg", F.lit(-1.0)).alias("average_time"))


def perplexity(log: DataFrame, step: str = "step", loss: str = "eval_loss") -> DataFrame:
    """``exp(eval_loss)`` per evaluation step (mean loss of the step)."""
    return log.groupBy(step).agg(F.exp(F.avg(loss)).alias("perplexity"))


def image_path(dataset: str, text, process=0, annotate: bool = False, out_dir: str = "") -> Column:
    """P8 + P9: annotation image path vs. per-process image path."""
    key = image_key(text)
    if annotate:
        return F.concat(F.lit(f"{out_dir}{ANNOTATION_FOLDER}/{dataset}_"), key, F.lit(".png"))
    return F.concat(F.lit(f"{out_dir}{dataset}_process"), _col(process).cast("string") if not isinstance(
        process, int) else F.lit(str(process)), F.lit("_"), key, F.lit(".png"))


def candidate_image(dataset: str, text, *keys, out_dir: str = "") -> Column:
    """Path of a candidate's image, named by a hash of the dataset, the
    candidate's keys and its whole text: texts with a common opening never
    share an image (the 50-character form of :func:`image_path` can)."""
    return F.concat(F.lit(f"{out_dir}{dataset}_"), _image_hash(dataset, text, *keys), F.lit(".png"))


def _image_hash(dataset: str, text, *keys) -> Column:
    named = [F.coalesce(F.concat(F.lit("="), _col(k).cast("string")), F.lit("~")) for k in (*keys, text)]
    return F.sha2(F.concat_ws("\x1f", F.lit(dataset), *named), 256)


def image_digest(dataset: str, text, *keys) -> Column:
    """The hash in a candidate's image name as 32 bytes, a third of the path."""
    return F.unhex(_image_hash(dataset, text, *keys))


def image_of_digest(dataset: str, digest, out_dir: str = "") -> Column:
    """The path that :func:`candidate_image` gives, from its :func:`image_digest`."""
    return F.concat(F.lit(f"{out_dir}{dataset}_"), F.lower(F.hex(_col(digest))), F.lit(".png"))


def relative_path(path, base: str) -> Column:
    """P10: drop the output prefix, prepend ``./``."""
    return F.concat(F.lit("./"), F.substring(_col(path), len(base) + 1, 1 << 30))


def mime_type(path) -> Column:
    ext = F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))
    expr = F.lit(DEFAULT_MIME)
    for e, m in MIME_TYPES.items():
        expr = F.when(ext == e, F.lit(m)).otherwise(expr)
    return expr


def data_url(path, content) -> Column:
    """``data:<mime>;base64,<content>``, one unbroken line whatever the
    session's ``spark.sql.chunkBase64String.enabled`` says (MIME chunking
    inserts CRLF every 76 characters; those are removed)."""
    b64 = F.replace(F.base64(_col(content)), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), b64)
