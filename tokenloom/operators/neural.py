"""Attention, transformer blocks and optimizer steps over tables of arrays.

Matrix products of whole sequences run in NumPy, in Arrow functions that get the weights
with their code; a row is one sequence, so nothing is shuffled. What works number by number,
as an optimizer step, is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.arrays import doubles


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the last dimension; places of minus infinity get 0, also where all are."""
    most = x.max(axis=-1, keepdims=True)
    e = np.exp(x - np.where(np.isfinite(most), most, 0))
    return e / np.maximum(e.sum(axis=-1, keepdims=True), np.finfo(float).tiny)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """``... queries d``, ``... keys d`` and ``... keys e`` give ``... queries e``; places where
    the mask is false count for nothing. Any number of leading dimensions."""
    scores = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    if mask is not None:
        scores = np.where(mask, scores, -np.inf)
    return softmax(scores) @ v


def rope(x: np.ndarray, positions: np.ndarray, theta: float = 10_000.0) -> np.ndarray:
    """Neighbouring pairs of the last dimension turned by their position."""
    width = x.shape[-1]
    angle = positions[..., None] / theta ** (np.arange(0, width, 2) / width)
    turned = (x[..., 0::2] + 1j * x[..., 1::2]) * np.exp(1j * angle)
    return np.stack([turned.real, turned.imag], axis=-1).reshape(x.shape)


def multihead(
    x: np.ndarray,
    wq: np.ndarray,
    wk: np.ndarray,
    wv: np.ndarray,
    wo: np.ndarray,
    heads: int,
    theta: float | None = None,
    positions: np.ndarray | None = None,
    causal: bool = True,
) -> np.ndarray:
    """Self attention of ``... length d``, all heads in one product; with ``theta`` queries
    and keys are turned by their positions, which count from 0 unless given."""
    length = x.shape[-2]

    def split(w: np.ndarray) -> np.ndarray:
        y = x @ w.T
        return np.swapaxes(y.reshape(*y.shape[:-1], heads, -1), -2, -3)

    q, k, v = split(wq), split(wk), split(wv)
    if theta is not None:
        at = np.arange(length) if positions is None else np.asarray(positions)[..., None, :]
        q, k = rope(q, at, theta), rope(k, at, theta)
    mask = np.tril(np.ones((length, length), bool)) if causal else None
    out = np.swapaxes(attention(q, k, v, mask), -2, -3)
    return out.reshape(*out.shape[:-2], -1) @ wo.T


def rmsnorm(x: np.ndarray, weight: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps) * weight


def swiglu(x: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
    gate = x @ w1.T
    return (gate / (1 + np.exp(-gate)) * (x @ w3.T)) @ w2.T


def block(x: np.ndarray, w: Mapping[str, np.ndarray], heads: int, theta: float) -> np.ndarray:
    """A transformer block that normalizes first. Weights by the public names: ``ln1``,
    ``attn.q_proj`` and so on, ``ln2``, ``ffn.w1`` to ``ffn.w3``, each with ``.weight``."""
    g = lambda name: w[f"{name}.weight"]
    projections = (g(f"attn.{n}_proj") for n in ("q", "k", "v", "output"))
    x = x + multihead(rmsnorm(x, g("ln1")), *projections, heads, theta)
    return x + swiglu(rmsnorm(x, g("ln2")), g("ffn.w1"), g("ffn.w2"), g("ffn.w3"))


def language_model(ids: np.ndarray, w: Mapping[str, np.ndarray], layers: int, heads: int, theta: float) -> np.ndarray:
    """Logits of the next token at every place of ``... length`` ids."""
    x = w["token_embeddings.weight"][ids]
    for k in range(layers):
        mine = f"layers.{k}."
        x = block(x, {n[len(mine) :]: v for n, v in w.items() if n.startswith(mine)}, heads, theta)
    return rmsnorm(x, w["ln_final.weight"]) @ w["lm_head.weight"].T


def next_token_logits(
    df: DataFrame, w: Mapping[str, np.ndarray], layers: int, heads: int, theta: float = 10_000.0, ids: str = "ids"
) -> DataFrame:
    """``logits``, those behind the last id of each row, beside the other columns. Null and
    empty lists of ids give null."""
    weights = dict(w)

    @F.pandas_udf("array<double>")
    def logits(lists: pd.Series) -> pd.Series:
        one = lambda x: None if x is None or not len(x) else language_model(np.asarray(x), weights, layers, heads, theta)[-1]
        return pd.Series([one(x) for x in lists], dtype=object)

    return df.withColumn("logits", logits(F.col(ids)))


def over_sequences(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], x: str, out: str) -> DataFrame:
    """A column ``out`` of ``f`` of the sequence of vectors in ``x``. Null and empty sequences
    give null."""

    @F.pandas_udf("array<array<double>>")
    def apply(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or not len(r) else f(np.stack(list(r))).tolist() for r in rows], dtype=object)

    return df.withColumn(out, apply(F.col(x)))


def attended(df: DataFrame, w: Mapping[str, np.ndarray], heads: int, theta: float | None = None, x: str = "x") -> DataFrame:
    """``attended``: multi-head self attention of the sequences in ``x``, by the weights ``q``,
    ``k``, ``v`` and ``o``."""
    weights = [np.asarray(w[n], float) for n in "qkvo"]
    return over_sequences(df, lambda r: multihead(r, *weights, heads, theta), x, "attended")


def transformed(df: DataFrame, w: Mapping[str, np.ndarray], heads: int, theta: float = 10_000.0, x: str = "x") -> DataFrame:
    """``transformed``: a transformer block of the sequences in ``x``."""
    weights = {n: np.asarray(v, float) for n, v in w.items()}
    return over_sequences(df, lambda r: block(r, weights, heads, theta), x, "transformed")


def adamw(
    p: Column,
    g: Column,
    m: Column,
    v: Column,
    step: Column,
    rate: float = 1e-3,
    betas: tuple[float, float] = (0.9, 0.999),
    eps: float = 1e-8,
    decay: float = 0.01,
) -> Column:
    """``struct(p, m, v)`` after one step of AdamW on arrays of parameters, gradients and
    both moments; ``step`` counts from 1. Without a gradient nothing changes."""
    b1, b2 = betas
    m_ = F.zip_with(doubles(m), doubles(g), lambda x, y: b1 * x + (1 - b1) * y)
    v_ = F.zip_with(doubles(v), doubles(g), lambda x, y: b2 * x + (1 - b2) * y * y)
    scale = rate * F.sqrt(1 - F.pow(F.lit(b2), step)) / (1 - F.pow(F.lit(b1), step))
    moved = F.zip_with(doubles(p), F.zip_with(m_, v_, lambda x, y: scale * x / (F.sqrt(y) + eps)), lambda x, y: x - y)
    kept = F.zip_with(moved, doubles(p), lambda x, y: x - rate * decay * y)
    new = F.struct(kept.alias("p"), m_.alias("m"), v_.alias("v"))
    return F.when(g.isNotNull(), new).otherwise(F.struct(doubles(p).alias("p"), doubles(m).alias("m"), doubles(v).alias("v")))


def save_state(state: DataFrame, path: str, iteration: int) -> None:
    """Parameters and moments with the iteration they are from."""
    state.withColumn("iteration", F.lit(iteration)).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The saved parameters and moments, and their iteration; 0 for an empty state."""
    saved = spark.read.parquet(path)
    row = saved.select("iteration").first()
    return saved.drop("iteration"), row[0] if row else 0
