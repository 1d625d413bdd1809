"""Tag lists and captions as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.rand import dropped, shuffled, uniform

# The names under which ratings are known.
RATING_ALIASES = {"g": "g", "general": "g", "safe": "g", "s": "s", "sensitive": "s", "suggestive": "s", "q": "q", "questionable": "q", "e": "e", "explicit": "e"}


def trimmed(value: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def as_tags(value: Column) -> Column:
    """A tag string as an array: split at commas if it holds one, else at white space; null gives no tags."""
    parts = F.when(F.contains(value, F.lit(",")), F.split(value, ",")).otherwise(F.split(value, r"(?U)\s+"))
    tags = F.filter(F.transform(parts, trimmed), lambda x: x != "")
    return F.coalesce(tags, F.array().cast("array<string>"))


def rating(value: Column) -> Column:
    """One-letter rating, empty if unknown."""
    pairs = [F.lit(x) for kv in RATING_ALIASES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(trimmed(value))), F.lit(""))


def rating_allowed(value: Column, allowed: list[str] | None) -> Column:
    """Whitelist by normalised rating. None or an empty list allows all; a list of unknown names allows none."""
    if not allowed:
        return F.lit(True)
    known = sorted({RATING_ALIASES[a.strip().lower()] for a in allowed if a.strip().lower() in RATING_ALIASES})
    return rating(value).isin(known) if known else F.lit(False)


def raw_rating_allowed(value: Column, allowed: list[str] | None) -> Column:
    """Whitelist by the lower-cased rating as it stands, without other names."""
    return F.lower(trimmed(value)).isin([a.strip().lower() for a in allowed]) if allowed else F.lit(True)


def has_caption(*columns: Column) -> Column:
    """Whether any of the caption or tag columns holds something."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(c, F.lit("")) != "")
    return out


@dataclass(frozen=True)
class CaptionOptions:
    general_dropout: float = 0.10
    character_dropout: float = 0.02
    shuffle: bool = True
    max_tags: int = 128
    spaces: bool = True
    artist: bool = True
    rating: bool = True
    quality: bool = True

    def __post_init__(self) -> None:
        if not (0.0 <= self.general_dropout <= 1.0 and 0.0 <= self.character_dropout <= 1.0):
            raise ValueError("dropout probabilities lie between 0 and 1")
        if self.max_tags < 1:
            raise ValueError("max_tags is 1 or more")


def caption(general: Column, character: Column, copyright_: Column, artist: Column, meta: Column, rating_: Column, quality: Column, seed: tuple = (), options: CaptionOptions = CaptionOptions()) -> Column:
    """A caption from arrays of tags: prefix, characters, copyrights, general tags, meta tags.

    General and character tags are dropped at random, general ones shuffled, each by hashed uniforms
    of ``seed``. Repeated tags stay at their first place; underscores become spaces after that, so
    ``a_b`` and ``a b`` are two tags. ``max_tags`` counts the prefix too.
    """
    o = options
    if o.general_dropout > 0:
        general = dropped(general, o.general_dropout, "g", *seed)
    if o.character_dropout > 0:
        character = dropped(character, o.character_dropout, "c", *seed)
    if o.shuffle:
        general = shuffled(general, "s", *seed)
    none = F.array().cast("array<string>")
    q, r = trimmed(F.coalesce(quality, F.lit(""))), trimmed(F.coalesce(rating_, F.lit("")))
    prefix = [none]
    if o.quality:
        prefix.append(F.when(q != "", F.array(F.when(F.contains(q, F.lit("quality")), q).otherwise(F.concat(q, F.lit(" quality"))))).otherwise(none))
    if o.rating:
        prefix.append(F.when(r != "", F.array(F.when(F.startswith(r, F.lit("rating:")), r).otherwise(F.concat(F.lit("rating:"), r)))).otherwise(none))
    if o.artist:
        prefix.append(F.transform(artist, lambda t: F.concat(F.lit("artist:"), t)))
    tags = F.slice(F.array_distinct(F.filter(F.concat(*prefix, character, copyright_, general, meta), lambda t: t != "")), 1, o.max_tags)
    shown = F.transform(tags, lambda t: F.replace(t, F.lit("_"), F.lit(" "))) if o.spaces else tags
    return F.array_join(shown, ", ")


# Multipliers of the seeds that name a sample's place in the stream.
EPOCH, EPOCH_STREAM, SHARD, SHARD_STREAM, SAMPLE = 2_000_003, 1_000_003, 7_919, 9_176, 104_729


def caption_seed(seed: Column, epoch: Column, shard: Column, sample: Column) -> Column:
    return seed + epoch * EPOCH + shard * SHARD + sample * SAMPLE


def stream_seed(seed: Column, epoch: Column, shard: Column, worker: Column) -> Column:
    return seed + epoch * EPOCH_STREAM + shard * SHARD_STREAM + worker


def stream_caption_seed(seed: Column, epoch: Column, shard: Column, worker: Column) -> Column:
    return seed + epoch * EPOCH + shard * SHARD + worker


def guidance_seed(seed: Column, epoch: Column, shard: Column, sample: Column) -> Column:
    return seed + epoch * EPOCH_STREAM + shard * SHARD_STREAM + sample * SAMPLE


def guidance_dropout(text: Column, probability: float, seed: Column) -> Column:
    """The caption, blank where the uniform of its seed is below the probability."""
    return F.when(uniform("cfg", seed) < F.lit(float(probability)), F.lit("")).otherwise(text)
