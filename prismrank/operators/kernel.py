"""Spectral weights and test-time refinement, in batches of samples.

What SQL cannot express is an eigen-decomposition and an optimizer.  Both run
on the B x B Gram matrix of a sample's bands, for all samples of an Arrow batch
at once; the vectors themselves are needed for the last weighted sum only.
Bands are an array column, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Config:
    """Parameters of the whole pipeline."""

    sigma: float = 0.5
    tau: float | None = None
    normalize_inputs: bool = True
    normalized_laplacian: bool = True
    num_steps: int = 5
    lr: float = 0.01
    lambda_m: float = 0.1
    k: int = 5
    grad_clip: float | None = 1.0
    early_stop_tol: float = 1e-6
    l2_normalize_output: bool = True

    def __post_init__(self) -> None:
        if self.sigma <= 0 or self.lr <= 0 or self.k < 1 or self.num_steps < 0 or (self.tau is not None and self.tau <= 0):
            raise ValueError(f"bad parameters: {self}")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def query_weights(e: np.ndarray, q: np.ndarray, c: Config) -> np.ndarray:
    e, q = (unit(e), unit(q)) if c.normalize_inputs else (e, q)
    return softmax(np.einsum("nbd,nd->nb", e, q) / c.sigma)


def affinity(e: np.ndarray, q: np.ndarray, c: Config) -> np.ndarray:
    w = query_weights(e, q, c)
    u = unit(e) if c.normalize_inputs else e
    s = u @ u.transpose(0, 2, 1)
    s = np.maximum(s, 0.0) if c.tau is None else softmax(s / c.tau)
    a = s * w[:, :, None] * w[:, None, :]
    a = 0.5 * (a + a.transpose(0, 2, 1))
    d = a.sum(2) + 1e-8
    return a / np.sqrt(d[:, :, None] * d[:, None, :])


def laplacian(a: np.ndarray, normalized: bool = True) -> np.ndarray:
    a = 0.5 * (a + a.transpose(0, 2, 1))
    d = a.sum(2)
    eye = np.eye(a.shape[1])
    if normalized:
        r = 1.0 / np.sqrt(np.maximum(d, 1e-12))
        out = eye - a * r[:, :, None] * r[:, None, :]
    else:
        out = d[:, :, None] * eye - a
    return 0.5 * (out + out.transpose(0, 2, 1))


def trivial(a: np.ndarray, normalized: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The vector that every graph's Laplacian maps to zero, and the degrees."""
    d = 0.5 * (a + a.transpose(0, 2, 1)).sum(2)
    v = np.sqrt(np.maximum(d, 0)) if normalized else np.ones_like(d)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), d


def spectrum(a: np.ndarray, normalized: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the Laplacian without its trivial one, from
    the smallest: the first is the second smallest of all.  The trivial vector is
    moved beyond the others, so that a graph that falls apart has vectors that
    are orthogonal to it as well."""
    if a.shape[1] < 2:
        raise ValueError("a graph needs two bands at least")
    t, d = trivial(a, normalized)
    beyond = 4.0 + 4.0 * d.max(1)[:, None, None]
    values, vectors = np.linalg.eigh(laplacian(a, normalized) + beyond * t[:, :, None] * t[:, None, :])
    return values[:, :-1], vectors[:, :, :-1]


def fiedler(a: np.ndarray, normalized: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A5: all eigenvalues, and the eigenvector of the second smallest."""
    values, vectors = spectrum(a, normalized)
    t, _ = trivial(a, normalized)
    return np.concatenate([np.einsum("ni,nij,nj->n", t, laplacian(a, normalized), t)[:, None], values], 1), vectors[:, :, 0]


#: Eigenvalues that differ by less are one.
EQUAL = 1e-6


def fiedler_weights(a: np.ndarray, normalized: bool = True) -> np.ndarray:
    """Magnitudes of the vector, to a sum of 1; its sign does not matter.
    Where several vectors have the same eigenvalue, those of their plane (the
    root of the diagonal of the projection on it), which no choice of vectors
    changes."""
    values, vectors = spectrum(a, normalized)
    same = values - values[:, :1] < EQUAL
    v = np.sqrt((vectors**2 * same[:, None, :]).sum(2))
    return v / np.maximum(v.sum(1, keepdims=True), 1e-12)


def fiedler_properties(a: np.ndarray, normalized: bool = True) -> dict[str, np.ndarray]:
    """How well the vector meets its definition.  In the normalized case
    it is orthogonal to the roots of the degrees, not to a constant vector."""
    values, v = fiedler(a, normalized)
    lap, (t, _) = laplacian(a, normalized), trivial(a, normalized)
    return {
        "lambda_1": values[:, 0], "lambda_2": values[:, 1], "gap": values[:, 2] - values[:, 1] if values.shape[1] > 2 else np.full(len(values), np.inf),
        "residual": np.linalg.norm(np.einsum("nij,nj->ni", lap, v) - values[:, 1:2] * v, axis=1),
        "orthogonality": np.abs((t * v).sum(1)), "norm": np.linalg.norm(v, axis=1),
    }


def neighbour_counts(e: np.ndarray, k: int) -> np.ndarray:
    """How often each band is one of another band's k nearest."""
    n, b, _ = e.shape
    if k >= b:
        raise ValueError(f"k={k} needs more than {k} bands, there are {b}")
    d = np.linalg.norm(e[:, :, None, :] - e[:, None, :, :], axis=3)
    d[:, np.arange(b), np.arange(b)] = np.inf
    near = np.argsort(d, axis=2, kind="stable")[:, :, :k]
    counts = np.zeros((n, b))
    np.add.at(counts, (np.arange(n)[:, None], near.reshape(n, -1)), 1.0)
    return counts


def refine(e: np.ndarray, w: np.ndarray, c: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A10: weights, losses (NaN after the last step) and steps.  The loss is a
    mean of distances |f - e_b|, weighted by how often band b is a neighbour;
    distances and gradient follow from the Gram matrix."""
    n, b, _ = e.shape
    g = e @ e.transpose(0, 2, 1)
    diagonal = np.einsum("nbb->nb", g)
    share = neighbour_counts(e, c.k) * c.lambda_m / (b * c.k)
    x = np.log(np.maximum(w, 1e-8))
    m, v = np.zeros_like(x), np.zeros_like(x)
    losses = np.full((n, c.num_steps), np.nan)
    steps, open_ = np.zeros(n, int), np.ones(n, bool)
    for t in range(c.num_steps):
        p = softmax(x)
        gp = np.einsum("nij,nj->ni", g, p)
        r = np.sqrt(np.maximum((p * gp).sum(1, keepdims=True) - 2 * gp + diagonal, 0.0))
        losses[open_, t] = (share * r).sum(1)[open_]
        pull = np.where(r > 0, share / np.where(r > 0, r, 1.0), 0.0)
        # u_b = e_b . gradient of the loss by the fused vector
        u = pull.sum(1, keepdims=True) * gp - np.einsum("nij,nj->ni", g, pull)
        grad = p * (u - (p * u).sum(1, keepdims=True))
        if c.grad_clip is not None:
            grad = grad * np.minimum(1.0, c.grad_clip / (np.linalg.norm(grad, axis=1, keepdims=True) + 1e-6))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = c.lr * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.999 ** (t + 1))) + 1e-8)
        x = np.where(open_[:, None], x - move, x)
        steps[open_] += 1
        if t:
            open_ &= ~(np.abs(losses[:, t - 1] - losses[:, t]) < c.early_stop_tol)
        if not open_.any():
            break
    return softmax(x), losses, steps


def fuse(e: np.ndarray, w: np.ndarray, normalize: bool) -> np.ndarray:
    f = np.einsum("nb,nbd->nd", w, e)
    return unit(f) if normalize else f


def pipeline(e: np.ndarray, q: np.ndarray, c: Config) -> dict[str, np.ndarray]:
    """Affinity, spectral weights, refinement, fusion."""
    start = fiedler_weights(affinity(e, q, c), c.normalized_laplacian)
    weights, losses, steps = refine(e, start, c)
    return {"initial_weights": start, "weights": weights, "fused": fuse(e, weights, c.l2_normalize_output), "losses": losses, "steps": steps}


# ---- the same on DataFrames -----------------------------------------------


def cubes(bands: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of one shape together: their places and an (n, B, D) array."""
    rows = [np.array(r, dtype=np.float64) for r in bands.to_pylist()]
    by: dict[tuple[int, ...], list[int]] = {}
    for i, r in enumerate(rows):
        if r.ndim != 2:
            raise ValueError("bands must be vectors of one length")
        by.setdefault(r.shape, []).append(i)
    return [(np.array(at), np.stack([rows[i] for i in at])) for at in by.values()]


def _apply(batches: Iterator[pa.RecordBatch], sample: str, bands: str, query: str, configs: list[dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[dict] = []
        ids, queries = batch[sample].to_pylist(), batch[query].to_pylist()
        for at, e in cubes(batch[bands]):
            q = np.array([queries[i] for i in at], dtype=np.float64)
            for number, c in enumerate(configs):
                c = Config(**c)
                r = pipeline(e, q, c)
                for n, i in enumerate(at.tolist()):
                    steps = int(r["steps"][n])
                    out.append({"sample": ids[i], "config": number, "initial_weights": r["initial_weights"][n].tolist(), "weights": r["weights"][n].tolist(), "fused": r["fused"][n].tolist(), "losses": r["losses"][n, :steps].tolist(), "steps": steps})
        schema = pa.schema([("sample", batch.schema.field(sample).type), ("config", pa.int32()), *((x, pa.list_(pa.float64())) for x in ("initial_weights", "weights", "fused", "losses")), ("steps", pa.int32())])
        yield pa.RecordBatch.from_pylist(out, schema)


def run(samples: DataFrame, configs: list[Config] | Config, sample: str = "sample_id", bands: str = "bands", query: str = "query") -> DataFrame:
    """Per sample and config (by its place in the list):
    initial_weights, weights, fused, losses, steps.  Samples are batched by
    shape; the config list is a parameter, so a grid costs no join."""
    configs = [configs] if isinstance(configs, Config) else configs
    kind = samples.schema[sample].dataType.simpleString()
    schema = f"sample {kind}, config int, initial_weights array<double>, weights array<double>, fused array<double>, losses array<double>, steps int"
    plain = [asdict(c) for c in configs]
    out = samples.select(sample, bands, query).mapInArrow(lambda it: _apply(it, sample, bands, query, plain), schema)
    return out.withColumnRenamed("sample", sample)


def _spectra(batches: Iterator[pa.RecordBatch], sample: str, matrix: str, normalized: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, ids = [], batch[sample].to_pylist()
        for at, a in cubes(batch[matrix]):
            w, p = fiedler_weights(a, normalized), fiedler_properties(a, normalized)
            out += [{"sample": ids[i], "weights": w[n].tolist(), **{k: float(x[n]) for k, x in p.items()}} for n, i in enumerate(at.tolist())]
        names = ("lambda_1", "lambda_2", "gap", "residual", "orthogonality", "norm")
        schema = pa.schema([("sample", batch.schema.field(sample).type), ("weights", pa.list_(pa.float64())), *((n, pa.float64()) for n in names)])
        yield pa.RecordBatch.from_pylist(out, schema)


def spectra(graphs: DataFrame, sample: str = "sample_id", matrix: str = "affinity", normalized: bool = True) -> DataFrame:
    """A5, A6, A7 per row: weights, lambda_1, lambda_2, gap, residual,
    orthogonality, norm."""
    kind = graphs.schema[sample].dataType.simpleString()
    schema = f"sample {kind}, weights array<double>, lambda_1 double, lambda_2 double, gap double, residual double, orthogonality double, norm double"
    return graphs.select(sample, matrix).mapInArrow(lambda it: _spectra(it, sample, matrix, normalized), schema).withColumnRenamed("sample", sample)
