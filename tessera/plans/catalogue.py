"""The catalogue of operations: what each takes, and which function does it or why none does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.sniff import FAMILIES
from tessera.operators.convert import KERNELS

#: Operations done by relational functions over page, line, word or file tables (operation: function).
PLANNED = {
    "merge_pdfs": "convert.packed", "pack_zip": "convert.packed", "pack_tar": "convert.packed", "audio_merge": "convert.packed", "images_to_pdf": "convert.packed", "images_to_gif": "convert.packed",
}

_PIXELS, _FRAMES, _SOUND, _PDF = "needs a lossy codec or a text renderer", "needs a video codec", "needs an audio codec", "needs a PDF renderer or cipher"
#: Operations without a function, and why.
UNSUPPORTED = {
    **dict.fromkeys(("compress_image", "image_watermark", "gif_watermark"), _PIXELS),
    **dict.fromkeys(("video_to_gif", "video_to_image", "convert_video", "video_merge", "video_crop", "video_watermark"), _FRAMES),
    **dict.fromkeys(("extract_audio",), _SOUND),
    **dict.fromkeys(("compress_pdf", "pdf_to_images", "encrypt_pdf", "decrypt_pdf"), _PDF),
    **dict.fromkeys(("unpack_rar",), "needs an unpacker that isn't installed"),
    "ocr_text": "needs an OCR engine; columns.ocr_normalize only cleans text that was recognised elsewhere",
    "compress_video": f"{_FRAMES}; columns.video_bitrate only gives the bit rate",
    "burn_subtitles": f"{_FRAMES}; relational.interval_lookup only finds the cue of each time",
    "video_trim": "cutting videos isn't implemented; columns.time_ranges only reads the ranges",
    "fill_pdf_form": "filling PDF forms isn't implemented; columns.form_values only reads the values",
}


@dataclass(frozen=True)
class Operation:
    name: str
    source: str
    done_by: str | None
    reason: str | None


def _source(name: str) -> str:
    head = name.split("_")[0]
    special = {"md": "text", "office": "docx", "sql": "text", "ini": "text", "toml": "text", "yaml": "text", "csv": "text", "format": "json", "unpack": "zip", "untar": "tar", "clean": "image", "ico": "ico", "image": "image", "audio": "audio", "convert": "text"}
    return special.get(head, head if head != "text" else "text")


def operations() -> list[Operation]:
    made = [Operation(k, _source(k), f"convert.{k}", None) for k in KERNELS]
    made += [Operation(k, _source(k), v, None) for k, v in PLANNED.items()]
    return sorted(made + [Operation(k, _source(k), None, v) for k, v in UNSUPPORTED.items()], key=lambda o: o.name)


def operation_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o.name, o.source, o.done_by, o.reason) for o in operations()], "operation string, source string, done_by string, reason string")


def kind_table(spark: SparkSession) -> DataFrame:
    """(kind, family): the dimension of file kinds."""
    return spark.createDataFrame([(k, f) for f, kinds in FAMILIES.items() for k in sorted(kinds)], "kind string, family string")
