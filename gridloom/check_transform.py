"""python -m gridloom.check_transform URL --var NAME --transform MODULE:ATTR [--chunk K] [--sample-axis A]

Runs a chunk transform on one chunk and compares what it gives with what it declares. Exit 0: fine, 1: it fails, 2: it cannot be tried.
"""

from __future__ import annotations

import argparse
import pkgutil
import runpy
import sys
import time

import numpy as np

from .operators.transforms import checked, output_geometry
from .plans.geometry import Geometry
from .sources.stores import filesystem, read_whole
from .sources.ztensor import layouts, whole_chunk


def load(target: str):
    """What MODULE:ATTR or FILE.py:ATTR names; of a class, an object."""
    where, _, attr = target.rpartition(":")
    found = runpy.run_path(where)[attr] if where.endswith(".py") else pkgutil.resolve_name(target)
    if isinstance(found, type):
        found = found()
    if not callable(found):
        raise TypeError(f"{target} cannot be called")
    return found


def read_chunk(url: str, variable: str, chunk: int, sample_axis: int = 0) -> tuple[np.ndarray, Geometry]:
    layout = layouts(url, [variable], sample_axis)[variable]
    g = layout.geometry
    if chunk not in range(g.n_chunks):
        raise IndexError(f"{variable} has {g.n_chunks} chunks")
    fs, top = filesystem(url)
    return whole_chunk(layout, chunk, lambda key: read_whole(fs, f"{top}/{variable}/{key}")), g


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="check_transform")
    p.add_argument("url")
    p.add_argument("--var", required=True)
    p.add_argument("--transform", required=True)
    p.add_argument("--chunk", type=int, default=0)
    p.add_argument("--sample-axis", type=int, default=0)
    a = p.parse_args(argv)
    try:
        transform = load(a.transform)
        values, g = read_chunk(a.url, a.var, a.chunk, a.sample_axis)
    except Exception as e:
        print(f"cannot try it: {type(e).__name__}: {e}", file=sys.stderr)
        return 2
    try:
        declared = output_geometry(g, [transform])
        began = time.perf_counter()
        out = transform(a.var, values.copy(), g.samples(a.chunk).start)
        took = time.perf_counter() - began
        if len(out) != len(values):
            raise ValueError(f"it gave {len(out)} samples of {len(values)}")
        if out.dtype != np.dtype(declared.dtype) and hasattr(transform, "output_inner"):
            raise ValueError(f"it gave {out.dtype}, declared is {declared.dtype}")
        out = checked(out, declared)
    except Exception as e:
        print(f"FAIL: {type(e).__name__}: {e}")
        return 1
    if out.dtype.kind == "f" and (bad := int((~np.isfinite(out)).sum())):
        print(f"warning: {bad} values are not finite")
    print(f"OK: {values.shape} {values.dtype} -> {out.shape} {out.dtype}, {took * 1e3:.2f} ms a chunk")
    return 0


if __name__ == "__main__":
    sys.exit(main())
