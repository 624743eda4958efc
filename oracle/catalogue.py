"""Imports every module that defines fragments or final statements."""

import retailflow.plans.catalogue  # noqa: F401
from oracle import domain, f_agg, f_check, f_core, f_join, f_scalar, f_scan, f_stream, facts  # noqa: F401
from oracle import statement
from oracle.finals import FINALS

STATEMENTS = {name: statement(sql) for name, sql in FINALS.items()}
