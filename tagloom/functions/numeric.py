"""Numeric kernels of flow matching and its network as expressions over array<double>."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.rand import uniform


def timesteps_uniform(*seed: Column | str | int) -> Column:
    return uniform(*seed)


def timesteps_logit_normal(*seed: Column | str | int) -> Column:
    """Sigmoid of a standard normal number (Box and Muller, 1958)."""
    z = F.sqrt(-2.0 * F.log(1.0 - uniform("a", *seed))) * F.cos(2.0 * math.pi * uniform("b", *seed))
    return 1.0 / (1.0 + F.exp(-z))


def lerp(clean: Column, noise: Column, t: Column) -> Column:
    return F.zip_with(clean, noise, lambda a, b: (1.0 - t) * a + t * b)


def velocity(clean: Column, noise: Column) -> Column:
    return F.zip_with(clean, noise, lambda a, b: b - a)


def rounded(value: Column | str, digits: int) -> Column:
    """A double to ``digits`` decimals as DuckDB rounds it: scaled, to the nearest whole number (halves away from 0), scaled back.

    Spark's own ``round`` rounds the shortest decimal form of a double, which differs by one in the last
    place where scaling meets or misses a half. What scaling would make infinite stays as it is.
    """
    x, scale = F.col(value) if isinstance(value, str) else value, 10.0**digits
    return F.when(F.abs(x * scale) <= sys.float_info.max, F.round(x * scale) / scale).otherwise(x)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def learning_rate(step: Column, warmup: int, steps: int, least: float) -> Column:
    """Linear from 0, then half a cosine down to ``least``."""
    progress = (step - warmup) / float(max(steps - warmup, 1))
    cosine = 0.5 * (1.0 + F.cos(F.least(progress, F.lit(1.0)) * math.pi))
    return F.when(step < warmup, step / float(max(warmup, 1))).otherwise(least + (1.0 - least) * cosine)


def guided(without: Column, with_: Column, scale: Column | float) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.zip_with(without, with_, lambda u, c: u + scale * (c - u))


def integrate(start: Column, steps: int, field: Callable[[Column, Column], Column], heun: bool = False) -> Column:
    """The state at t = 0 from t = 1 in equal steps; Heun's last step is Euler's.

    ``field(x, t)`` gives the velocity array of the state array x.
    """

    def move(x: Column, i: Column) -> Column:
        t, after = 1.0 - i / float(steps), 1.0 - (i + 1) / float(steps)
        dt = after - t
        v = field(x, t)
        euler = F.zip_with(x, v, lambda a, b: a + dt * b)
        if not heun:
            return euler
        mean = F.zip_with(v, field(euler, after), lambda a, b: 0.5 * (a + b))
        return F.when(i < steps - 1, F.zip_with(x, mean, lambda a, b: a + dt * b)).otherwise(euler)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, move)


def timestep_embedding(t: Column, width: int, period: float = 10000.0) -> Column:
    half = width // 2
    freq = lambda i: F.exp(i * (-math.log(period) / max(half - 1, 1)))
    places = F.sequence(F.lit(0), F.lit(half - 1))
    out = F.concat(F.transform(places, lambda i: F.cos(t * freq(i))), F.transform(places, lambda i: F.sin(t * freq(i))))
    return F.concat(out, F.array(F.lit(0.0))) if width % 2 else out


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + eps)
    return F.transform(x, lambda v: v / scale)


def rotate_pairs(x: Column) -> Column:
    """(a, b) to (-b, a) in each pair of neighbours."""
    return F.transform(x, lambda v, i: F.when(i % 2 == 0, -F.get(x, i + 1)).otherwise(F.get(x, i - 1)))


def rope_phase(y: Column, x: Column, place: Column, head_dim: int, theta: float = 10000.0, stretch: float = 4.0) -> Column:
    """Phase of one place of a head: the first half turns with the row, the second with the column, two places a frequency."""
    pairs = head_dim // 4
    half = 2 * pairs
    n = F.floor((place % half) / 2)
    inverse = F.pow(F.lit(theta), -n / float(max(pairs, 1)))
    return F.when(place < half, y).otherwise(x) * inverse / stretch


def modulate(x: Column, scale: Column, shift: Column) -> Column:
    return F.zip_with(F.zip_with(x, scale, lambda a, s: a * (1.0 + s)), shift, lambda a, b: a + b)


def gated(x: Column, gate: Column, update: Column) -> Column:
    return F.zip_with(x, F.zip_with(gate, update, lambda g, u: g * u), lambda a, b: a + b)


def gelu_tanh(x: Column) -> Column:
    return F.transform(x, lambda v: 0.5 * v * (1.0 + F.tanh(math.sqrt(2.0 / math.pi) * (v + 0.044715 * v * v * v))))


def unpatchify(tokens: Column, rows: int, columns: int, patch: int, channels: int) -> Column:
    """A flat (rows, columns, patch, patch, channels) array as a flat (channels, rows * patch, columns * patch) one."""
    width, height = columns * patch, rows * patch

    def source(i: Column) -> Column:
        c, y, x = F.floor(i / (height * width)), F.floor(i / width) % height, i % width
        cell = F.floor(y / patch) * columns + F.floor(x / patch)
        return ((cell * patch + y % patch) * patch + x % patch) * channels + c

    return F.transform(F.sequence(F.lit(0), F.lit(channels * height * width - 1)), lambda i: F.get(tokens, source(i).cast("int")))


def padded(items: Column, to: Column) -> Column:
    """A ragged array of doubles with zeros up to a length."""
    return F.concat(items, F.array_repeat(F.lit(0.0), (to - F.size(items)).cast("int")))


def mask(length: Column, to: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), to), lambda i: i <= length)


# Names under which number formats are known.
DTYPES = {"bfloat16": "bfloat16", "bf16": "bfloat16", "float16": "float16", "fp16": "float16", "float32": "float32", "fp32": "float32"}


def dtype(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in DTYPES.items() for x in kv]), F.lower(name))


def dtype_policy(precision: Column, parameters: Column) -> Column:
    """struct<compute, parameters, scaler>: half precision keeps single-precision parameters unless told otherwise."""
    compute = dtype(F.coalesce(precision, F.lit("bfloat16")))
    kept = F.when(parameters.isNotNull(), dtype(parameters)).when(compute == "float16", "float32").otherwise(compute)
    return F.struct(compute.alias("compute"), kept.alias("parameters"), ((compute == "float16") & (kept != "float16")).alias("scaler"))


def optimizer_policy(name: Column, eight_bit: Column, fallback: Column) -> Column:
    """Which optimizer runs, or ``error``: the 8-bit one falls back to the plain one where that is allowed."""
    n = F.lower(F.coalesce(name, F.lit("adamw")))
    return F.when(n == "adamw", "adamw").when((n == "adamw8bit") & eight_bit, "adamw8bit").when((n == "adamw8bit") & fallback, "adamw").otherwise("error")


def model_errors(hidden: Column, heads: Column, patch: Column, depth: Column, backend: Column) -> Column:
    """Names of the rules that a model's configuration breaks."""
    checks = [
        ("hidden_size", hidden % heads != 0),
        ("head_dim", F.floor(hidden / heads) % 4 != 0),
        ("patch_size", patch < 1),
        ("depth", depth < 1),
        ("attention_backend", ~backend.isin("sdpa", "flash_attention_2")),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())


def param_counts(shapes: DataFrame) -> DataFrame:
    """section, parameters and tensors of a table of weights (section, shape array<bigint>); a scalar's empty shape counts one."""
    size = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, x: a * x)
    return shapes.groupBy("section").agg(F.sum(size).alias("parameters"), F.count(F.lit(1)).alias("tensors"))
