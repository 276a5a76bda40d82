"""Named queries: importing this registers them all."""

from . import micro, ssb, tpch  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
