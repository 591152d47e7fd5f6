"""Registry of the library's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tessella
from tessella import queries_core, queries_mesh

# Workers get the functions themselves, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(tessella)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = queries_core.QUERIES | queries_mesh.QUERIES
ORACLES: dict[str, str] = queries_core.ORACLES | queries_mesh.ORACLES
