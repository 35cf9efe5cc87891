"""The dictionary as Markdown. The format is fixed; what a column's last cell says is a list of notes, each made by one
function of the column's facts."""

from __future__ import annotations

from collections.abc import Iterator

# fixed values: the title, and the columns of a file's table
TITLE = "Data dictionary"
COLUMNS = ("column", "dtype", "%missing", "cardinality", "sensitive", "coverage/description")


def _months(c: dict) -> str:
    found = c.get("temporal_coverage")
    return "{min_month}→{max_month}, {cadence}".format(**found) if found else ""


def _template(c: dict) -> str:
    found = c.get("format") or {}
    return f"fmt=`{found['template']}`{' (mixed)' * bool(found.get('mixed'))}" if found else ""


def _structure(c: dict) -> str:
    found = c.get("temporal_distribution")
    if not found:
        return ""
    weights = found.get("diurnal_blocks") or {"?": 0}
    return f"struct: peak {max(weights, key=weights.get)}h, active {found['active_day_rate']:.0%}"


NOTES = (_months, lambda c: c.get("description") or "", _template, _structure)


def _row(*cells: object) -> str:
    return f"| {' | '.join(map(str, cells))} |"


def _file(name: str, prof: dict) -> Iterator[str]:
    said = {"rows": prof["row_count"], "subjects": prof.get("cohort_n")}
    facts = [f"{n} {what}" for what, n in said.items() if n is not None] + ["role=codebook"] * (prof.get("role") == "codebook")
    yield f"\n## {name}  ({', '.join(facts)})"
    yield from (f"> {line}" for line in prof.get("file_metadata", ()))
    yield "\n" + _row(*COLUMNS)
    yield "|" + "---|" * len(COLUMNS)
    for column, c in prof["columns"].items():
        yield _row(column, *(c.get(k, False) for k in ("dtype", "pct_missing", "cardinality", "sensitive")), "; ".join(filter(None, (note(c) for note in NOTES))))
    yield from (f"\n**{column}:** {'; '.join(values)}" for column, values in prof.get("codebook_text", {}).items() if values)


def markdown(dictionary: dict) -> str:
    lines = [f"# {TITLE}"]
    for source, files in dictionary["sources"].items():
        lines.append(f"\n# {source or '(root)'}")
        lines += [line for name, prof in files.items() for line in _file(name, prof)]
    return "\n".join(lines) + "\n"
