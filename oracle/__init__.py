"""DuckDB oracle: every booking query as SQL over the bridge tables."""

from .audit import audit_dirty_sql, audit_sql
from .changes import changes_sql
from .dml import dml_sql
from .reports import report_sql


def oracle_queries() -> dict[str, str]:
    out = {}
    out.update(report_sql())
    out["audit"] = audit_sql()
    out["audit_dirty"] = audit_dirty_sql()
    out.update(changes_sql())
    out.update(dml_sql())
    return out
