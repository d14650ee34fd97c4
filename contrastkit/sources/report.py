"""Small results as text: Markdown tables, number formats and SVG charts. Only what a limit bounds is collected."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

#: The colours of bars, in turn.
COLOURS = ("#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2")


def decimals(value: float | None, places: int = 4) -> str:
    """Fixed decimals; blank if there is no finite number. Minus zero is zero."""
    if value is None or not math.isfinite(value):
        return ""
    text = f"{value:.{places}f}"
    return text.lstrip("-") if float(text) == 0 else text


def significant(value: float | None, digits: int = 12) -> str:
    """So many significant digits, without zeros at the end; blank if there is no finite number."""
    if value is None or not math.isfinite(value):
        return ""
    return "0" if value == 0 else f"{value:.{digits}g}"


def percent(value: float | None) -> str:
    return "" if value is None or not math.isfinite(value) else f"{100 * value:.1f}%"


def _cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, float):
        return decimals(value)
    if isinstance(value, list):
        return "; ".join(_cell(x) for x in value)
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown(rows: DataFrame, limit: int = 50, columns: Sequence[str] | None = None) -> str:
    """A table of the first rows, with a row of dots if there are more. The order is that of the table."""
    names = list(columns or rows.columns)
    found = rows.select(*names).limit(limit + 1).collect()
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    lines += ["| " + " | ".join(_cell(v) for v in row) + " |" for row in found[:limit]]
    if len(found) > limit:
        lines.append("| " + " | ".join("..." for _ in names) + " |")
    return "\n".join(lines)


def sections(title: str, parts: Sequence[tuple[str, str | DataFrame]], limit: int = 50) -> str:
    """A Markdown report: headings, each with text or a table."""
    out = [f"# {title}"]
    for heading, body in parts:
        out += [f"## {heading}", body if isinstance(body, str) else markdown(body, limit)]
    return "\n\n".join(out) + "\n"


#: Headings of the reports, and the parts of an analysis below each.
AUDIT = {"Verdict": "verdict", "Classes": "classes", "Imbalance": "imbalance", "Identities in one class": "dependency", "Classes by key": "degrees", "Keys in several classes": "shared_keys", "Rows in such keys": "rows_in_shared_keys", "Keys that two classes share": "pair_overlap"}
GENERIC = {"Classes": "classes", "Identities by class": "identities", "Identities in one class": "dependency"}
STUDY = {"Verdict": "verdict", "Gate": "gate", "Rows left out": "exclusions", "Conflicting labels": "conflicts", "Classes": "classes", "Associations": "associations", "Crossed contexts": "crossed", "Contexts that two classes share": "pair_overlap", "Differences in prevalence": "prevalence_summary", "Models": "pooled", "Models with shuffled classes": "shuffled"}
CONTRASTS = {"Verdict": "verdict", "What is left": "reduction", "Share left": "survival", "Contrasts of classes": "summary", "Contrasts in strongly overlapping contexts": "strong_overlap_summary", "Residuals": "residual_summary", "Residual range against permutations": "range_permutation", "Contrasts against permutations": "pair_permutation", "Bootstrap of contexts": "context_bootstrap", "Bootstrap of identities": "cluster_bootstrap", "Without each identity": "leave_one_out", "Pairings": "pairings"}


def analysis_report(title: str, found: Mapping[str, DataFrame], headings: Mapping[str, str], limit: int = 20) -> str:
    """A Markdown report of the parts of an analysis that are there, in the order of the headings; parts by other names
    follow under their own."""
    parts = [(heading, found[name]) for heading, name in headings.items() if name in found]
    if headings is GENERIC:
        parts += [(name, frame) for name, frame in found.items() if name not in headings.values()]
    return sections(title, parts, limit)


def _escaped(text: object) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;")


def bars(rows: DataFrame, label: str, value: str, title: str, limit: int = 30, width: int = 420) -> str:
    """Horizontal bars, scaled to the largest."""
    found = rows.select(label, value).limit(limit).collect()
    most = max((r[1] or 0 for r in found), default=0) or 1
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 320}" height="{40 + 24 * len(found)}" font-family="sans-serif" font-size="12">', f'<text x="8" y="20">{_escaped(title)}</text>']
    for k, (name, n) in enumerate(found):
        y = 36 + 24 * k
        out.append(f'<text x="8" y="{y + 12}">{_escaped(name)}</text><rect x="220" y="{y}" width="{width * (n or 0) / most:.1f}" height="16" fill="{COLOURS[k % len(COLOURS)]}"/><text x="{226 + width * (n or 0) / most:.1f}" y="{y + 12}">{_cell(n)}</text>')
    return "\n".join([*out, "</svg>"])


def dots(rows: DataFrame, label: str, value: str, title: str, limit: int = 60, width: int = 400, longest: int = 56) -> str:
    """Differences as dots between -1 and 1."""
    found = [r for r in rows.select(label, value).limit(limit).collect() if r[1] is not None]
    middle = 400 + width / 2
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 440}" height="{50 + 18 * len(found)}" font-family="sans-serif" font-size="11">', f'<text x="8" y="20">{_escaped(title)}</text>', f'<line x1="{middle}" y1="30" x2="{middle}" y2="{40 + 18 * len(found)}" stroke="#999"/>']
    for k, (name, x) in enumerate(found):
        name, y = str(name), 44 + 18 * k
        name = name if len(name) <= longest else name[: longest - 3] + "..."
        out.append(f'<text x="8" y="{y + 4}">{_escaped(name)}</text><circle cx="{middle + width / 2 * min(1, max(-1, x)):.1f}" cy="{y}" r="4" fill="{COLOURS[0]}"/>')
    return "\n".join([*out, "</svg>"])
