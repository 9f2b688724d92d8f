"""The engine's own queries over the driver's tables."""

from sparkloom.plans import checks, corpus, filing, links, references, search, sources, terms  # noqa: F401
from sparkloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
