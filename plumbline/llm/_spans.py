"""Column helpers for texts with very many spans."""

from plumbline.functions.spans import CHUNK, STRIDE, cutter, let, running, total

__all__ = ["CHUNK", "STRIDE", "cutter", "let", "running", "total"]
