"""Media columns: texts stored as GIFs, GIFs decoded to timed frames with colour histograms.

Defined results: a null text counts as empty; an empty text is 64 zero bytes; equal texts have
equal media; any number of frames and any length is kept; unreadable media give ``error`` and no
frames; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gif
from .common import Batcher, rows_of, small_batches, table

FRAME = "struct<frame:int,delay_ms:int,width:int,height:int,histogram:array<bigint>>"
_ARROW_FRAMES = pa.list_(pa.struct([("frame", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]))


def padded(raw: bytes) -> bytes:
    """``raw`` and zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % gif.WIDTH or (0 if raw else gif.WIDTH))


def frames_of(image: gif.Gif) -> list[dict]:
    out = []
    for k, (f, (delay, canvas)) in enumerate(zip(image.frames, gif.composed(image), strict=True)):
        out.append({"frame": k, "delay_ms": delay, "width": f.width, "height": f.height, "histogram": gif.histogram(canvas)})
    return out


_MEDIA = pa.schema([("media", pa.binary()), ("samples", pa.binary()), ("frames", _ARROW_FRAMES), ("error", pa.string())])


def read_media(data: bytes | None, max_samples: int | None = gif.MAX_SAMPLES) -> tuple:
    """media, samples, frames, error of one GIF."""
    try:
        if data is None:
            raise gif.GifError("no media")
        image = gif.decode(data, max_samples)
        return data, gif.samples_of(image), frames_of(image), None
    except (gif.GifError, IndexError, ValueError, MemoryError, struct.error) as e:
        return data, None, [], str(e) or type(e).__name__


def _mapped(df: DataFrame, source: F.Column, keep: tuple[str, ...], extra: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    """``keep`` columns, ``extra`` columns and the media columns; make(value) gives all but the kept ones."""
    names = [f"k{n}" for n in range(len(keep))]
    small_batches(df.sparkSession)

    def run(batches):
        out = None
        for batch in batches:
            if out is None:
                out = Batcher(pa.schema([*((c, batch.schema.field(n).type) for n, c in zip(names, keep, strict=True)), *((c, t) for c, _, t in extra), *_MEDIA]))
            for *kept, value in rows_of([batch], *names, "v"):
                made = make(value)
                if out.add((*kept, *made), 2 * len(made[-4] or b"")):
                    yield out.flush()
        if out:
            yield out.flush()

    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), *(T.StructField(c, t) for c, t, _ in extra), T.StructField("media", T.BinaryType()), T.StructField("samples", T.BinaryType()), T.StructField("frames", T._parse_datatype_string(f"array<{FRAME}>")), T.StructField("error", T.StringType())])
    return df.select(*(F.col(c).alias(n) for n, c in zip(names, keep, strict=True)), source.alias("v")).mapInArrow(run, schema)


def _stored(raw: bytes | None) -> tuple:
    raw = raw or b""
    return (len(raw), *read_media(gif.encode(padded(raw)), None))  # its own, however long


def text_to_gif(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns, n_bytes (unpadded) and the media columns of each whole text stored as a GIF and read back.

    media: the stored form; samples: the zero-padded UTF-8 bytes as read from it; frames: timed, with
    colour histograms; error: null.
    """
    return _mapped(docs, F.encode(F.col(text_col), "UTF-8"), keep, [("n_bytes", T.LongType(), pa.int64())], _stored)


def gif_columns(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the media columns of a column of GIFs."""
    return _mapped(df, F.col(media_col), keep, [], read_media)


def op8_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text stored as a GIF and read back, with the colour histogram of all frames as shown."""
    read = text_to_gif(table(spark, sf_dir, "documents"))
    none = F.array_repeat(F.lit(0).cast("long"), 64)
    histogram = F.aggregate("frames", none, lambda s, f: F.zip_with(s, f["histogram"], lambda x, y: x + y))
    delay = F.aggregate("frames", F.lit(0), lambda s, f: s + f["delay_ms"])
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), F.size("frames"), F.lit(";ms="), delay, F.lit(";colours="), F.array_join(histogram, ",")).alias("feature"),
        F.size("frames").alias("n_frames"),
    )
