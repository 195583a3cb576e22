"""All registered queries."""

from cuespan.plans import (  # noqa: F401 - each module registers its queries
    interval_queries,
    file_queries,
    layout_queries,
    segment_queries,
    stream_queries,
    text_queries,
)
from cuespan.plans.registry import QUERIES  # noqa: F401
