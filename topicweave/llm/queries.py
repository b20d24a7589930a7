"""All queries of this subpackage: importing it registers them."""

from topicweave.llm import (  # noqa: F401
    decontaminate,
    divergence,
    filter_audit,
    ftrl,
    packing,
    quality_bayes,
    quality_rules,
    secrets,
    simhash,
    source_mix,
    suffix_dedup,
    url_filter,
    warc,
)
from topicweave.llm.common import ORACLE, QUERIES  # noqa: F401
