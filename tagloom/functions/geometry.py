"""Resolution buckets as Column expressions over a small literal table; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The buckets (width, height) of each training stage, in order of preference.
STAGES: dict[int, tuple[tuple[int, int], ...]] = {
    512: ((512, 512), (448, 576), (576, 448), (416, 608), (608, 416), (384, 672), (672, 384)),
    768: ((768, 768), (672, 896), (896, 672), (640, 960), (960, 640), (576, 1024), (1024, 576)),
    1024: ((1024, 1024), (864, 1152), (1152, 864), (832, 1248), (1248, 832), (736, 1312), (1312, 736)),
}
#: A bucket's sides are multiples of this; a latent side is one sixteenth, a token covers two latent places.
STEP, LATENT = 32, 16


def stage_buckets(stage: int) -> tuple[tuple[int, int], ...]:
    if stage not in STAGES:
        raise ValueError(f"stage {stage} is not one of {sorted(STAGES)}")
    return STAGES[stage]


def valid(width: Column, height: Column) -> Column:
    return (width > 0) & (height > 0) & (width % STEP == 0) & (height % STEP == 0)


def key(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def aspect(width: Column, height: Column) -> Column:
    return width.cast("double") / height.cast("double")


def latent_side(side: Column) -> Column:
    return F.floor(side / LATENT)


def tokens(width: Column, height: Column) -> Column:
    return F.floor(width / STEP) * F.floor(height / STEP)


def parse_key(value: Column) -> Column:
    """struct<width, height> of WIDTHxHEIGHT in either case; null where it isn't a valid bucket."""
    parts = F.split(F.lower(value), "x", 2)
    side = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.when(valid(side(0), side(1)), F.struct(side(0).alias("width"), side(1).alias("height")))


def parse_size(value: Column) -> Column:
    """struct<height, width> of HEIGHTxWIDTH, also written with a multiplication sign."""
    parsed = parse_key(F.replace(value, F.lit("×"), F.lit("x")))
    return F.when(parsed.isNotNull(), F.struct(parsed["width"].alias("height"), parsed["height"].alias("width")))


def choose(width: Column, height: Column, buckets: tuple[tuple[int, int], ...]) -> Column:
    """struct<width, height> of the bucket nearest in aspect ratio, then in area, then first in order.

    The ratio of ratios, larger over smaller, orders buckets as the absolute logarithm does, without
    rounding in a logarithm. Images without positive sides give null.
    """
    w, h = width.cast("long"), height.cast("long")

    def rank(i: int, bw: int, bh: int) -> Column:
        ratio = F.greatest(w * bh, h * bw).cast("double") / F.least(w * bh, h * bw)
        return F.struct(ratio.alias("ratio"), F.abs(w * h - bw * bh).alias("area"), F.lit(i).alias("ord"), F.lit(bw).alias("width"), F.lit(bh).alias("height"))

    best = F.array_min(F.array(*[rank(i, bw, bh) for i, (bw, bh) in enumerate(buckets)]))
    return F.when((w > 0) & (h > 0), F.struct(best["width"].alias("width"), best["height"].alias("height")))


def upscale(width: Column, height: Column, bucket: Column) -> Column:
    """By how much the image must grow to cover the bucket."""
    return F.greatest(bucket["width"].cast("double") / width, bucket["height"].cast("double") / height)


def cover_crop(width: Column, height: Column, bucket: Column) -> Column:
    """struct of the size after covering the bucket and of the centred crop box."""
    scale = upscale(width, height, bucket)
    rw = F.greatest(bucket["width"].cast("long"), F.ceil(width * scale))
    rh = F.greatest(bucket["height"].cast("long"), F.ceil(height * scale))
    left, top = F.floor((rw - bucket["width"]) / 2), F.floor((rh - bucket["height"]) / 2)
    return F.struct(rw.alias("resized_width"), rh.alias("resized_height"), left.alias("left"), top.alias("top"), (left + bucket["width"]).alias("right"), (top + bucket["height"]).alias("bottom"))


def bucket_table(stage: int) -> Column:
    """map<key, struct<width, height>> of a stage."""
    pairs = []
    for w, h in stage_buckets(stage):
        pairs += [F.lit(f"{w}x{h}"), F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))]
    return F.create_map(*pairs)


def pixel_to_unit(values: Column) -> Column:
    """Bytes 0..255 to [-1, 1]."""
    return F.transform(values, lambda x: x / F.lit(127.5) - F.lit(1.0))


def unit_to_pixel(values: Column) -> Column:
    """[-1, 1], clamped, to bytes; halves go to the even byte."""
    return F.transform(values, lambda x: F.bround((F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) + 1.0) * 127.5).cast("int"))
