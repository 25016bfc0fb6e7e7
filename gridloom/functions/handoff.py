"""Batches for machine-learning frameworks. Each framework is optional and named in the error where it is missing."""

from __future__ import annotations

import importlib
import time

import numpy as np


def arrays(rows: list, labels: list[str], inner: dict[str, tuple[int, ...]] | None = None) -> dict[str, np.ndarray]:
    """Rows of one batch as label -> array of (rows, *inner shape)."""
    out = {}
    for k in labels:
        a = np.array([r[k] for r in rows])
        out[k] = a.reshape(len(rows), *inner[k]) if inner and k in inner else a
    return out


def _need(module: str, extra: str):
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"{module} is not installed; install the {extra!r} extra") from e


def to_torch(batch: dict[str, np.ndarray]) -> dict:
    torch = _need("torch", "torch")
    return {k: torch.from_numpy(np.ascontiguousarray(v)) for k, v in batch.items()}


def to_jax(batch: dict[str, np.ndarray]) -> dict:
    jnp = _need("jax.numpy", "jax")
    return {k: jnp.asarray(v) for k, v in batch.items()}


def to_tf(batch: dict[str, np.ndarray]) -> dict:
    tf = _need("tensorflow", "tf")
    return {k: tf.convert_to_tensor(v) for k, v in batch.items()}


def torch_dataset(dataset, split: str, labels: list[str], inner=None):
    torch = _need("torch", "torch")

    class Batches(torch.utils.data.IterableDataset):
        def __iter__(self):
            return (to_torch(arrays(rows, labels, inner)) for rows in dataset.iterate(split))

    return Batches()


def tf_dataset(dataset, split: str, labels: list[str], inner: dict[str, tuple[int, ...]], dtype: str = "float32"):
    tf = _need("tensorflow", "tf")
    signature = {k: tf.TensorSpec((None, *inner[k]), dtype) for k in labels}
    return tf.data.Dataset.from_generator(lambda: (arrays(rows, labels, inner) for rows in dataset.iterate(split)), output_signature=signature).prefetch(2)


class Timed:
    """Passes batches through and keeps the times of a pass: seconds to the first batch, waits for each next one, and the consumer's own."""

    def __init__(self, batches):
        self.batches, self.first, self.waits, self.work = batches, None, [], []

    def __iter__(self):
        asked = time.perf_counter()
        for b in self.batches:
            came = time.perf_counter()
            if self.first is None:
                self.first = came - asked
            else:
                self.waits.append(came - asked)
            yield b
            asked = time.perf_counter()
            self.work.append(asked - came)

    @property
    def stall(self) -> float:
        """The share of time spent waiting, the first batch left out."""
        whole = sum(self.waits) + sum(self.work)
        return sum(self.waits) / whole if whole else 0.0
