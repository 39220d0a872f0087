"""Every query of the library and the SQL it is held against."""

from __future__ import annotations

from . import inventory, suite

QUERIES = {**suite.QUERIES, **inventory.QUERIES}
SQL = {**suite.SQL, **inventory.SQL}
