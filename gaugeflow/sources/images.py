"""Images: Spark's own decoder with failures kept as rows, and perceptual fingerprints in one Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRINTS = T.StructType([T.StructField("phash", T.LongType()), T.StructField("dhash", T.LongType()), T.StructField("feature", T.ArrayType(T.FloatType()))])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, channels, data and failed for every file; what cannot be decoded is a row of height -1, marked failed."""
    d = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    return d.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), (F.col("image.height") < 0).alias("failed"))


def gray(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Luma by the weights 299, 587, 114 of BGR data."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return pixels[:, :, 0]
    return np.floor((pixels[:, :, 2] * 299 + pixels[:, :, 1] * 587 + pixels[:, :, 0] * 114) / 1000 + 0.5)


def kernel(size: int, out: int, support: float, weight) -> np.ndarray:
    """Matrix that resamples ``size`` values to ``out`` with a filter that widens when it shrinks."""
    scale = max(1.0, size / out)
    centers = (np.arange(out) + 0.5) * size / out
    d = (np.arange(size)[None] + 0.5 - centers[:, None]) / scale
    w = np.where(np.abs(d) < support, weight(d), 0.0)
    return w / w.sum(1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int, smooth: bool) -> np.ndarray:
    """Resampled to whole grey levels, by a three-lobed Lanczos filter or (not smooth) a triangle."""
    support, weight = (3.0, lambda x: np.sinc(x) * np.sinc(x / 3)) if smooth else (1.0, lambda x: 1 - np.abs(x))
    across = kernel(image.shape[1], width, support, weight)
    down = kernel(image.shape[0], height, support, weight)
    return np.clip(np.floor(down @ (image @ across.T) + 0.5), 0, 255)


def dct(n: int) -> np.ndarray:
    """Orthonormal DCT-II matrix."""
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def packed(bits: np.ndarray) -> int:
    """64 bits, the first highest, as a signed number."""
    return int(np.packbits(bits.ravel().astype(np.uint8)).view(">i8")[0])


def fingerprint(image: np.ndarray) -> tuple[int, int, list[float]]:
    """phash (low 8 x 8 of the DCT against the median of all but the first), dhash (rises along rows), and the centred unit feature of 32 x 32."""
    d = dct(32)
    block = (d @ resized(image, 32, 32, True) @ d.T)[:8, :8]
    phash = packed(block >= np.median(block.ravel()[1:]))
    small = resized(image, 9, 8, True)
    dhash = packed(small[:, 1:] >= small[:, :-1])
    feature = resized(image, 32, 32, False).ravel()
    feature = feature - feature.mean()
    norm = np.linalg.norm(feature)
    return phash, dhash, (feature / norm if norm else feature).astype(np.float32).tolist()


@F.pandas_udf(PRINTS)
def fingerprints(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Fingerprints of (data, width, height, channels); null for what was not decoded."""
    for data, width, height, channels in parts:
        rows = [fingerprint(gray(b, w, h, c)) if h > 0 else (None, None, None) for b, w, h, c in zip(data, width, height, channels, strict=True)]
        yield pd.DataFrame(rows, columns=["phash", "dhash", "feature"])


def with_fingerprints(images: DataFrame) -> DataFrame:
    return images.withColumn("f", fingerprints("data", "width", "height", "channels")).select("path", "width", "height", "failed", "f.*")


#: Tags of dates: DateTime, DateTimeOriginal, DateTimeDigitized (fixed values).
DATE_TAGS = (306, 36867, 36868)


def exif_block(content: bytes) -> bytes:
    """The block of camera tags of a JPEG or PNG file; empty if it has none."""
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return content[at + 10 : at + 2 + size]
            at += 2 + size
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
    return b""


def date_tags(content: bytes) -> list[str]:
    """Values of the date tags in the first directory of a file's camera tags, in its order; none if the block is missing or broken."""
    block = exif_block(content)
    order = {b"II": "little", b"MM": "big"}.get(block[:2])
    number = lambda at, n: int.from_bytes(block[at : at + n], order)
    if order is None or len(block) < 8 or number(2, 2) != 42:
        return []
    first = number(4, 4)
    out = []
    for i in range(min(number(first, 2), (len(block) - first) // 12)):
        entry = first + 2 + 12 * i
        if number(entry, 2) in DATE_TAGS and number(entry + 2, 2) == 2:  # a text
            size = number(entry + 4, 4)
            at = entry + 8 if size <= 4 else number(entry + 8, 4)
            out.append(block[at : at + size].split(b"\0")[0].decode("ascii", "replace"))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def dates(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([date_tags(bytes(x)) for x in part])


def date_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(value, n): how often each value of a date tag occurs in the JPEG and PNG files below a folder. Files are read whole, so few of them are in a batch at a time."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.lower("path").rlike(r"\.(jpe?g|png)$"))
    return d.select(F.explode(dates("content")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
