"""The pretty report: a panel and tables for a terminal, from one row of Corpus.probe."""

from __future__ import annotations

import textwrap
from collections.abc import Sequence

from codegrove.operators.metrics import DETECTORS

_BOLD, _PLAIN = "\033[1m", "\033[0m"


def panel(title: str, text: str) -> str:
    wide = max(len(title) + 2, len(text))
    return "\n".join([f"╭─{f' {title} ':─^{wide}}─╮", f"│ {_BOLD}{text:<{wide}}{_PLAIN} │", f"╰─{'─' * wide}─╯"])


def table(title: str, head: Sequence[str], rows: Sequence[Sequence[str]], width: int = 100) -> str:
    """Columns as wide as their texts; the last one is wrapped to what is left of width."""
    sizes = [max(map(len, column)) for column in zip(head, *rows)]
    sizes[-1] = min(sizes[-1], max(20, width - sum(sizes[:-1]) - 3 * len(sizes) - 1))
    rule = lambda a, b, c: a + b.join("─" * (n + 2) for n in sizes) + c
    line = lambda cells: "│" + "│".join(f" {x:<{n}} " for x, n in zip(cells, sizes)) + "│"
    body = []
    for row in rows:
        parts = textwrap.wrap(row[-1], sizes[-1]) or [""]
        body += [line([*(row[:-1] if k == 0 else [""] * (len(row) - 1)), part]) for k, part in enumerate(parts)]
    return "\n".join([f"{_BOLD}{title}{_PLAIN}", rule("┌", "┬", "┐"), line(head), rule("├", "┼", "┤"), *body, rule("└", "┴", "┘")])


def pretty_report(row) -> str:
    """Tags, then links where there are tags."""
    out = [panel("Function Probe", f"{row.qualified_name} ({row.path}, lines {row.lineno}-{row.end_lineno})")]
    if not row.tags:
        return "\n".join([*out, f"No tag was raised by {', '.join(DETECTORS)}."])
    out.append(table("Detected tags", ("Tag", "Location", "Detail"), [(t.name, f"L{t.line}:{t.col}", t.detail) for t in row.tags]))
    if not row.links:
        return "\n".join([*out, "Catalog links: none — no catalog dogma claims these tags yet."])
    name = lambda e: f"§{e.entry_number} {e.entry_title}" if e.entry_kind == "dogma" and e.entry_number is not None else e.entry_title
    return "\n".join([*out, table("Catalog links", ("Tag", "Kind", "Entry"), [(e.tag_name, e.entry_kind, name(e)) for e in row.links])])
