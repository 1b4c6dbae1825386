"""All registered queries; importing the plan modules fills the registry."""

from glossmill.plans import chain, cleaning, datasets, encoding, mining, suggesting  # noqa: F401
from glossmill.plans.registry import ORACLES, QUERIES  # noqa: F401
