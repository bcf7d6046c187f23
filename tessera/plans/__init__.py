"""Named queries with their oracle SQL."""

from tessera.plans import engine, multimodal, relational, scalars, timeseries

QUERIES, ORACLES = {}, {}
for _module in (relational, scalars, timeseries, multimodal, engine):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
