"""Text states for training batches: captions of many batches encoded together, a batch padded on its own."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.batching import text_windows

#: From captions to one matrix (tokens, width) for each.
TextEncoder = Callable[[list[str]], list[np.ndarray]]


def word_states(captions: list[str], most: int = 32) -> list[np.ndarray]:
    """Stand-in for a text encoder: a row of (letters, place) for each of the first ``most`` words; no words give one empty token."""
    out = []
    for c in captions:
        words = re.split(r"\s+", c.strip())[:most] if c.strip() else [""]
        out.append(np.array([[len(w), i] for i, w in enumerate(words)], np.float32))
    return out


def _window(rows: pd.DataFrame, encoder: TextEncoder, encode: int) -> pd.DataFrame:
    rows = rows.sort_values("batch_no", kind="stable")
    flat = [c or "" for captions in rows["captions"] for c in captions]
    states: list[np.ndarray] = []
    for a in range(0, len(flat), encode):
        part = flat[a : a + encode]
        made = encoder(part)
        if len(made) != len(part):
            raise ValueError(f"{len(made)} states of {len(part)} captions")
        states += made
    padded, masks, at = [], [], 0
    for captions in rows["captions"]:
        group, at = states[at : at + len(captions)], at + len(captions)
        longest = max((len(x) for x in group), default=0)
        padded.append([np.concatenate((x, np.zeros((longest - len(x), *x.shape[1:]), x.dtype))).tolist() for x in group])
        masks.append([[True] * len(x) + [False] * (longest - len(x)) for x in group])
    return pd.DataFrame({"batch_no": rows["batch_no"], "text_window": rows["text_window"], "states": padded, "mask": masks})


def text_states(batches: DataFrame, encoder: TextEncoder = word_states, window: int = 256, encode: int = 32) -> DataFrame:
    """batch_no, text_window, states and mask of ``batches`` (batch_no, captions array<string>).

    A window of whole batches, ``window`` captions or a little more, is encoded in one task in calls of
    ``encode`` captions at most, across batches; each batch is then padded with zeros to its own longest
    caption, and the mask says which tokens are real. Null captions are empty ones; a batch may have none.
    """
    sized = batches.select("batch_no", F.size("captions").alias("size"))
    windows = text_windows(sized, window, encode).select("batch_no", "text_window")
    both = batches.select("batch_no", "captions").join(windows, "batch_no")
    return both.groupBy("text_window").applyInPandas(lambda g: _window(g, encoder, encode), "batch_no long, text_window long, states array<array<array<float>>>, mask array<array<boolean>>")
