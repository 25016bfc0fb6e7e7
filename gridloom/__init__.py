"""Chunk-aware sampling of n-dimensional arrays and tables on Spark."""

from .dataset import Dataset
from .functions.metrics import StandardScaler
from .operators.ordering import block_shuffled_order, chunk_permutation, sequential_order, shuffle_quality
from .operators.views import View, gather
from .plans.geometry import Geometry
from .plans.split import SPLITS, Manifest, split_by_chunk
from .sources.ztensor import open_geometries, register

__all__ = [
    "SPLITS", "Dataset", "Geometry", "Manifest", "StandardScaler", "View", "block_shuffled_order", "chunk_permutation", "gather", "open_geometries", "register", "sequential_order", "shuffle_quality",
    "split_by_chunk",
]
