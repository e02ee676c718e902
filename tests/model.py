"""A plain-Python statement of the rules, for tests over small inputs.

Rows are dictionaries in input order. Nothing here is used by the library.
"""

import datetime


def comparable(value):
    text = None if value is None else str(value).strip()
    return text or None


def key_of(row, key):
    return tuple(row[k] for k in key)


def labels(source, target, key, tracked):
    """Per snapshot row its type and changed fields, and the deleted keys."""
    last = {}
    for row in target:
        if row["is_current"]:
            last[key_of(row, key)] = row
    found = []
    for row in source:
        before = last.get(key_of(row, key))
        if before is None:
            found.append((row, "new", []))
            continue
        fields = [c for c in tracked if comparable(row[c]) != comparable(before[c])]
        found.append((row, "changed" if fields else "unchanged", fields))
    seen = {key_of(row, key) for row in source}
    return found, [k for k in last if k not in seen]


def apply(source, target, key, tracked, day):
    found, deleted = labels(source, target, key, tracked)
    kinds, newest = {}, {}
    for row, kind, _ in found:
        kinds.setdefault(key_of(row, key), set()).add(kind)
        newest[key_of(row, key)] = row
    out = []
    for row in target:
        if row["is_current"] is None:
            continue
        row = dict(row)
        kind = kinds.get(key_of(row, key), set())
        if row["is_current"] and "unchanged" not in kind:
            row["effective_to"], row["is_current"] = day, False
        out.append(row)
    for k, kind in kinds.items():
        if kind & {"changed", "new"}:
            data = {c: newest[k][c] for c in [*key, *tracked]}
            out.append({**data, "effective_from": day, "effective_to": None, "is_current": True})
    return out


def neighbours(table, key):
    """Consecutive versions of each key: by start with nulls first, then by end with nulls last."""
    first, last = datetime.date.min, datetime.date.max
    groups = {}
    for row in table:
        groups.setdefault(key_of(row, key), []).append(row)
    for group in groups.values():
        group.sort(key=lambda r: (r["effective_from"] or first, r["effective_to"] or last))
        yield from zip(group, group[1:])


def overlaps(table, key):
    for a, b in neighbours(table, key):
        end, start = a["effective_to"], b["effective_from"]
        if end is None or start is None or end > start:
            yield (key_of(a, key), a["effective_from"], end, start, b["effective_to"])


def gaps(table, key):
    for a, b in neighbours(table, key):
        if a["effective_to"] is not None and a["effective_to"] != b["effective_from"]:
            yield (key_of(a, key), a["effective_from"], a["effective_to"],
                   b["effective_from"], b["effective_to"])


def verdicts(table, key):
    current = {}
    for row in table:
        if row["is_current"]:
            current[key_of(row, key)] = current.get(key_of(row, key), 0) + 1
    return {
        "one_current_per_key": sum(n > 1 for n in current.values()),
        "no_null_keys": sum(None in key_of(r, key) for r in table),
        "no_overlapping_dates": len(list(overlaps(table, key))),
        "date_consistency": sum(
            None not in (r["effective_from"], r["effective_to"])
            and r["effective_from"] > r["effective_to"]
            for r in table
        ),
        "valid_current_records": sum(
            bool(r["is_current"]) and r["effective_to"] is not None for r in table
        ),
        "no_history_gaps": len(list(gaps(table, key))),
    }
