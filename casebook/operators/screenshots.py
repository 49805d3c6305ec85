"""Inline image extraction.

Per row: find every image data URL, number it (1-based, 3+ digits), replace
each successfully decodable URL by ``[SCREENSHOT: screenshot_<id>_<nnn>]`` in
order, and count the decodes.  The decoded images become a separate long
table (one row per image) that a sink can write.  All narrow: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def _items(key_col, text_col):
    urls = T.data_urls(text_col)
    return F.transform(
        urls,
        lambda u, i: F.struct(
            u.alias("url"),
            F.concat(F.lit("screenshot_"), key_col.cast("string"), F.lit("_"),
                     F.format_string("%03d", i + 1)).alias("name"),
            T.data_url_decodes(u).alias("ok"),
        ),
    )


def extract_screenshots(df: DataFrame, key: str, text: str, out: str = "processed_text") -> DataFrame:
    """P3 + A11: rewritten text and ``screenshot_count`` per row."""
    items = _items(F.col(key), F.col(text))
    rewritten = F.aggregate(
        items, F.col(text),
        lambda acc, x: F.when(x["ok"], F.replace(acc, x["url"], F.concat(F.lit("[SCREENSHOT: "), x["name"],
                                                                          F.lit("]")))).otherwise(acc))
    return df.select("*", F.when(F.col(text).isNull(), F.col(text)).otherwise(rewritten).alias(out),
                     F.coalesce(F.size(F.filter(items, lambda x: x["ok"])), F.lit(0)).alias("screenshot_count"))


def screenshot_images(df: DataFrame, key: str, text: str) -> DataFrame:
    """W4 + K6: one row per decodable image with number, name, extension and
    bytes (the binary column a sink writes)."""
    items = _items(F.col(key), F.col(text))
    ex = df.select(key, F.posexplode(items).alias("pos", "it")).filter(F.col("it.ok"))
    mime = F.regexp_extract(F.col("it.url"), r"^data:image/([^;]+);", 1)
    ext_map = F.create_map(*[F.lit(x) for kv in K.IMAGE_EXTENSIONS.items() for x in kv])
    return ex.select(
        key,
        (F.col("pos") + 1).alias("image_no"),
        F.col("it.name").alias("name"),
        F.coalesce(ext_map[mime], F.lit(K.DEFAULT_IMAGE_EXTENSION)).alias("extension"),
        T.data_url_bytes(F.col("it.url")).alias("image"),
    )
