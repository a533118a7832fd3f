"""All queries of the library but those of the llm subpackage."""

import loomtext.plans.columns
import loomtext.plans.structure
from loomtext.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
