"""Names, addresses and sizes of shards and their members as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of images, and the scheme and host of hub addresses.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
HUB, HUB_HOST = "hf://", "https://huggingface.co/"


def _slashes(name: Column) -> Column:
    return F.replace(name, F.lit("\\"), F.lit("/"))


def ending(name: Column) -> Column:
    """The last suffix of a path's name, lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(_slashes(name), r"[^/](\.[^./]+)$", 1))


def member_kind(name: Column) -> Column:
    """image, json or text; null for members that don't count."""
    e = ending(name)
    return F.when(e.isin(*IMAGE_ENDINGS), "image").when(e == ".json", "json").when(e == ".txt", "text")


def member_key(name: Column) -> Column:
    """The path without its last suffix; null for members that don't count."""
    path = _slashes(name)
    return F.when(member_kind(name).isNotNull(), F.substring(path, F.lit(1), F.char_length(path) - F.char_length(ending(name))))


def latent_key(name: Column) -> Column:
    """struct<key, kind> of a latent archive's member: ``.latent.npy`` or ``.json``; null for others."""
    cut = lambda end: F.substring(name, F.lit(1), F.char_length(name) - len(end))
    parts = lambda end, kind: F.struct(cut(end).alias("key"), F.lit(kind).alias("kind"))
    return F.when(F.endswith(name, F.lit(".latent.npy")), parts(".latent.npy", "latent")).when(F.endswith(name, F.lit(".json")), parts(".json", "json"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shard_bucket(source: Column) -> Column:
    """The four digits that name a shard, from a path or an address (query and fragment aside); null if its name isn't four digits."""
    path = F.regexp_replace(source, r"[?#].*$", "")
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(\d{4})(?:\.[^./]*)?$", 1), F.lit(""))


def is_remote(source: Column) -> Column:
    return F.rlike(source, F.lit(r"^(hf|https?)://"))


def _hub_parts(source: Column) -> tuple[Column, Column]:
    parts = F.split(F.substring(source, F.lit(len(HUB) + 1), F.char_length(source)), "/")
    return parts, F.startswith(source, F.lit(HUB)) & (F.size(parts) >= 5) & F.get(parts, F.lit(0)).isin("datasets", "models")


def hub_address(source: Column) -> Column:
    """The download address of a hub shard; other sources stay as they are, malformed hub ones give null."""
    parts, fine = _hub_parts(source)
    quote = lambda p: F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    name = F.array_join(F.transform(F.slice(parts, F.lit(4), F.size(parts)), quote), "/")
    kind = F.when(F.get(parts, F.lit(0)) == "datasets", "datasets/").otherwise("")
    made = F.concat(F.lit(HUB_HOST), kind, F.get(parts, F.lit(1)), F.lit("/"), F.get(parts, F.lit(2)), F.lit("/resolve/main/"), name)
    return F.when(~F.startswith(source, F.lit(HUB)), source).when(fine, made)


def hub_parts(source: Column) -> Column:
    """struct<repo_id, filename, repo_type> of a hub shard; null for other sources."""
    parts, fine = _hub_parts(source)
    return F.when(fine, F.struct(F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))).alias("repo_id"), F.array_join(F.slice(parts, F.lit(4), F.size(parts)), "/").alias("filename"), F.when(F.get(parts, F.lit(0)) == "datasets", "dataset").otherwise("model").alias("repo_type")))


def total_bytes(content_range: Column, content_length: Column, existing: Column, status: Column) -> Column:
    """Size of a download from its headers: the range's total, else the length (on top of what is there, if partial)."""
    ranged = F.regexp_extract(F.coalesce(content_range, F.lit("")), r"/(\d+)$", 1)
    plain = F.when(F.rlike(content_length, F.lit(r"^\d+$")), content_length.try_cast("bigint"))
    return F.when(ranged != "", ranged.try_cast("bigint")).when(status == 206, existing + plain).otherwise(plain)


def human_bytes(value: Column) -> Column:
    """With one decimal in B, KiB, MiB, GiB or TiB."""
    v, out = value.cast("double"), None
    for i, unit in enumerate(("B", "KiB", "MiB", "GiB")):
        shown = F.format_string(f"%.1f {unit}", v / float(1024**i))
        fits = F.abs(v) < float(1024 ** (i + 1))
        out = F.when(fits, shown) if out is None else out.when(fits, shown)
    return out.otherwise(F.format_string("%.1f TiB", v / float(1024**4)))


def gigabytes(value: Column) -> Column:
    return (value.cast("double") * float(1024**3)).cast("bigint")


def hash_id(length: int, *parts: Column) -> Column:
    """A prefix of the SHA-1 of the parts, separated by a zero character."""
    return F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, length)


def cache_name(source: Column) -> Column:
    """File name under which a downloaded shard is kept."""
    return F.concat(hash_id(16, source), F.lit("-"), basename(F.regexp_replace(source, r"[?#].*$", "")))


def checkpoint_step(name: Column) -> Column:
    """The number behind ``step-``, -1 if there is none."""
    return F.coalesce(F.regexp_extract(basename(name), r"^step-(\d+)$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
