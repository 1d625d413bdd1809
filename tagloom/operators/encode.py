"""Encoding images in batches of one shape, by a callable that stands for an image encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: From a batch (n, channels, height, width) to n latents.
Encoder = Callable[[np.ndarray], np.ndarray]


def block_means(pixels: np.ndarray, step: int = 16) -> np.ndarray:
    """Stand-in for an image encoder: means of 16 x 16 pixels, channels kept."""
    *lead, h, w = pixels.shape
    return pixels.reshape(*lead, h // step, step, w // step, step).mean((-3, -1))


class Halving:
    """An encoder whose batches shrink: where one doesn't fit (MemoryError), it goes in halves and later ones are no larger.

    The failed attempt is left before the halves are tried, so that nothing of it is held. One image that
    doesn't fit is an error, as is a number of latents other than that of the images.
    """

    def __init__(self, encoder: Encoder, most: int):
        if most < 1:
            raise ValueError("a batch holds an image at least")
        self.encoder, self.most = encoder, most

    def __call__(self, pixels: np.ndarray) -> list[np.ndarray]:
        if len(pixels) > self.most:
            return [x for a in range(0, len(pixels), self.most) for x in self(pixels[a : a + self.most])]
        try:
            out = list(self.encoder(pixels))
        except MemoryError:
            if len(pixels) == 1:
                raise
            out = None
        if out is None:
            half = len(pixels) // 2
            self.most = min(self.most, half)
            return [*self(pixels[:half]), *self(pixels[half:])]
        if len(out) != len(pixels):
            raise ValueError(f"{len(out)} latents of {len(pixels)} images")
        return out


def encoded(samples: DataFrame, encoder: Encoder = block_means, most: int = 16, skip: bool = False) -> DataFrame:
    """Samples (pixels array<float>, shape array<int>) with latent and latent_shape instead of pixels.

    A task holds up to ``most`` samples of each shape and gives them to the encoder as one batch; what
    is left goes at the end. Batches shrink as ``Halving`` says. ``skip``: the samples of a batch that
    fails otherwise, and those without pixels or with a wrong number of them, have null latents; else
    the error is raised.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        halving, waiting = Halving(encoder, most), {}

        def out(part: pd.DataFrame, made: list[np.ndarray] | None) -> pd.DataFrame:
            lists = [None] * len(part) if made is None else [np.asarray(x, np.float32).ravel().tolist() for x in made]
            shapes = [None] * len(part) if made is None else [list(x.shape) for x in made]
            return part.drop(columns="pixels").assign(latent=lists, latent_shape=shapes)

        def encode(part: pd.DataFrame, shape: tuple) -> pd.DataFrame:
            try:
                return out(part, halving(np.stack([np.asarray(p, np.float32).reshape(shape) for p in part["pixels"]])))
            except Exception:
                if not skip:
                    raise
                return out(part, None)

        for batch in batches:
            shapes = [tuple(int(n) for n in s) if s is not None and p is not None and len(p) == np.prod(s, dtype=np.int64) else None for s, p in zip(batch["shape"], batch["pixels"], strict=True)]
            bad = np.array([s is None for s in shapes], bool)
            if bad.any():
                if not skip:
                    raise ValueError("pixels don't fill their shape")
                yield out(batch[bad], None)
            for shape in dict.fromkeys(s for s in shapes if s is not None):
                part = batch[np.array([s == shape for s in shapes])]
                held = pd.concat([waiting.pop(shape), part]) if shape in waiting else part
                whole = len(held) // most * most
                for a in range(0, whole, most):
                    yield encode(held.iloc[a : a + most], shape)
                if whole < len(held):
                    waiting[shape] = held.iloc[whole:]
        for shape, held in waiting.items():
            yield encode(held, shape)

    fields = [f for f in samples.schema.fields if f.name != "pixels"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", latent array<float>, latent_shape array<int>"
    return samples.mapInPandas(run, schema)
