"""All registered queries of the subpackage."""

from lakewarden.llm import bpe, collocations, convtrie, fingerprints, linededup, lm, mixing, ngramjoin, pii, quality, secrets, sharding, simhash  # noqa: F401
from lakewarden.llm.common import ORACLE, QUERIES  # noqa: F401
