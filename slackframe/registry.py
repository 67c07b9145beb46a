"""All queries of the engine by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from slackframe.queries import files, maths, models, state

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for module in (state, models, maths, files):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
