"""Importing this module registers every query of the subpackage."""

from . import conversations, jaccard, licenses, mixing, neighbours, packing, personal, quality, secrets, suffixes, tokenfile, toxicity, whitening  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
