"""Consent-governed data access and audit analytics, expressed as Spark plans."""

from consentry.model import (  # noqa: F401
    CLEAR,
    DENY,
    MASK,
    Column,
    Condition,
    Consent,
    MaskRule,
    Subject,
    TableMeta,
)
from consentry.plans.governed import Governor  # noqa: F401
from consentry.session import build_session  # noqa: F401
