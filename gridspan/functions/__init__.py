"""Formula functions as Columns. `call(name, ...)` applies any of them; the modules hold them by family."""

from . import core, dates, distributions, engineering, finance, logical, maths, texts
from .core import FUNCTIONS, Val, call, lift

__all__ = ["FUNCTIONS", "Val", "call", "core", "dates", "distributions", "engineering", "finance", "lift", "logical", "maths", "texts"]
