"""Names shared by every operator."""

# The three metadata columns of a history table.
EFFECTIVE_FROM = "effective_from"
EFFECTIVE_TO = "effective_to"
IS_CURRENT = "is_current"
META = (EFFECTIVE_FROM, EFFECTIVE_TO, IS_CURRENT)

# The change types, in the order reports list them.
NEW = "new"
CHANGED = "changed"
UNCHANGED = "unchanged"
DELETED = "deleted"
CHANGE_TYPES = (NEW, CHANGED, UNCHANGED, DELETED)

# Position of a row in its input files, added by the loader on request. It only
# decides which of several rows with one key is the last; it is never data.
ROW_ORDER = "_row_order"

# The same of a history row, on reports: the order of deletions.
TARGET_ORDER = "_target_order"
ORDERS = (ROW_ORDER, TARGET_ORDER)


def data_columns(df) -> list[str]:
    """Columns of ``df`` that carry data: neither metadata nor the row position."""
    return [c for c in df.columns if c not in META and c != ROW_ORDER]
