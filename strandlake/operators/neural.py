"""Forward passes of learned operators from parameter tables: dense, convolution, attention, message passing.

Parameters are a small model, sent to tasks as NumPy arrays; rows pass through in Arrow batches. Training is MLlib's or the
caller's; `seeded` makes reproducible parameters for tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def seeded(seed: int, *shape: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1 / np.sqrt(shape[0]), shape)


def relu(x):
    return np.maximum(x, 0)


def gelu(x):
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def softmax(x, axis=-1):
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def layer_norm(x, eps: float = 1e-6):
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)


def mlp(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], last=None) -> np.ndarray:
    """Dense layers with relu between them."""
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k < len(layers) - 1:
            x = relu(x)
    return last(x) if last else x


def conv1d(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Same-padded convolution of (length, channels) with (width, channels, out)."""
    width = len(kernel)
    h = width // 2
    p = np.pad(x, ((h, width - 1 - h), (0, 0)))
    return sum(p[k : k + len(x)] @ kernel[k] for k in range(width)) + bias


def attention(x: np.ndarray, params: dict, heads: int = 2) -> np.ndarray:
    """Multi-head self-attention of (length, width)."""
    n, width = x.shape
    d = width // heads
    q, k, v = (np.transpose((x @ params[c]).reshape(n, heads, d), (1, 0, 2)) for c in "qkv")
    a = softmax(q @ np.transpose(k, (0, 2, 1)) / np.sqrt(d))
    return np.transpose(a @ v, (1, 0, 2)).reshape(n, width) @ params["o"]


def transformer_block(x: np.ndarray, params: dict, heads: int = 2) -> np.ndarray:
    """Pre-norm attention and a gelu feed-forward layer, each with a residual."""
    x = x + attention(layer_norm(x), params, heads)
    return x + gelu(layer_norm(x) @ params["up"]) @ params["down"]


def block_params(seed: int, width: int, inner: int) -> dict:
    shapes = {"q": (width, width), "k": (width, width), "v": (width, width), "o": (width, width), "up": (width, inner), "down": (inner, width)}
    return {c: seeded(seed + i, *s) for i, (c, s) in enumerate(shapes.items())}


def encode_sequence(codes: np.ndarray, params: dict, heads: int = 2, pooling: str = "mean") -> np.ndarray:
    """Sequence embedding: letters and sinusoidal places, one transformer block, mean or first position."""
    width = params["q"].shape[0]
    t = np.arange(len(codes))[:, None] / np.power(10000.0, np.arange(width)[None, :] / width)
    x = params["embed"][codes] + np.where(np.arange(width) % 2 == 0, np.sin(t), np.cos(t))
    y = transformer_block(x, params, heads)
    return y.mean(0) if pooling == "mean" else y[0]


def message_passing(nodes: np.ndarray, edges: np.ndarray, message: np.ndarray, update: np.ndarray) -> np.ndarray:
    """relu messages of sources summed at targets, then a relu update of node and sum; no edges: sums are zero."""
    total = np.zeros((len(nodes), message.shape[1]))
    if len(edges):
        np.add.at(total, edges[:, 1], relu(nodes[edges[:, 0]] @ message))
    return relu(np.concatenate([nodes, total], 1) @ update)


def graph_attention(nodes: np.ndarray, edges: np.ndarray, params: dict, heads: int = 2, v2: bool = False, slope: float = 0.2) -> np.ndarray:
    """Attention over incoming edges; v2 scores a . leaky_relu(left(target) + right(source))."""
    n, width = len(nodes), params["q"].shape[1]
    d = width // heads
    q, k, v = ((nodes @ params[c]).reshape(n, heads, d) for c in "qkv")
    out = np.zeros((n, heads, d))
    if len(edges):
        s, t = edges.T
        if v2:
            z = q[t] + k[s]
            score = (np.where(z > 0, z, slope * z) * params["a"].reshape(1, heads, d)).sum(-1)
        else:
            score = (q[t] * k[s]).sum(-1) / np.sqrt(d)
        top = np.full((n, heads), -np.inf)
        np.maximum.at(top, t, score)
        e = np.exp(score - top[t])
        total = np.zeros((n, heads))
        np.add.at(total, t, e)
        np.add.at(out, t, (e / (total[t] + 1e-10))[:, :, None] * v[s])
    return out.reshape(n, width) @ params["o"]


def vae_encode(x: np.ndarray, layers, mean: np.ndarray, logvar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and log-variance of a count encoder over log1p inputs."""
    h = relu(mlp(np.log1p(np.maximum(x, 0)), layers))
    return h @ mean, h @ logvar


def apply_model(df: DataFrame, vec: str, out: str, model) -> DataFrame:
    """Append array<double> `out`: model maps a batch matrix (rows, features) to (rows, outputs)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(batch.schema.get_field_index(vec)).to_pylist(), dtype=np.float64)
            y = model(x.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tolist() for r in y], pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
