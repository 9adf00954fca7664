"""All registered queries, by area."""

from consentry.queries import (  # noqa: F401
    audits,
    catalogs,
    consents,
    costs,
    joins,
    masks,
    predicates,
    sql,
    streams,
    texts,
    workflows,
)
from consentry.queries.base import ORACLES, QUERIES, Frames  # noqa: F401
