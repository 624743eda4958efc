"""Imports every module that registers queries."""

from retailflow.plans import q_agg, q_check, q_core, q_join, q_scalar, q_scan, q_stream  # noqa: F401
from retailflow.plans.registry import QUERIES  # noqa: F401
