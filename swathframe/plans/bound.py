"""All bound queries; importing this module registers them."""

from . import bound_files, bound_joins, bound_raster, bound_rules, bound_scalars, bound_scores, bound_splits  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
