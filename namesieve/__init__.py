"""namesieve: batch and micro-batch watchlist screening on PySpark."""

from namesieve.params import ScreeningParams

__all__ = ["ScreeningParams"]
