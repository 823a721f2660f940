"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from winnow.plans import queries_dedup, queries_files, queries_images, queries_media, queries_relational, queries_review, queries_rows, queries_state, queries_video  # noqa: F401
from winnow.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "s2_dedup_assessment"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
