"""All queries of the subpackage and their oracles; importing it registers them."""

from ledgerweave.llm import (  # noqa: F401
    chat,
    contamination,
    divergence,
    importance,
    langid,
    licenses,
    lm,
    mixing,
    neardup,
    quality,
    tokens,
    toxicity,
    vectors,
)
from ledgerweave.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
