"""Reports of small result tables: Markdown tables, bar charts, assembled text. The driver holds only what is printed."""

from __future__ import annotations

import hashlib
import re
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1000


def rows_of(df: DataFrame, *order: str) -> list[dict]:
    """The rows of a report table; an error if there are too many for a page."""
    found = (df.orderBy(*order) if order else df).limit(ROWS + 1).collect()
    if len(found) > ROWS:
        raise ValueError(f"more than {ROWS} rows for a report")
    return [r.asDict() for r in found]


def markdown(header: list[str], rows: list[list]) -> str:
    cell = lambda x: "" if x is None else str(x).replace("|", r"\|")
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in [header, ["---"] * len(header), *rows])


def mean_std_pivot(summary: DataFrame, metric: str, rows: str = "condition", columns: str = "model") -> str:
    """A cell for each row and column value: "mean ± std", n/a where there is none."""
    found = {(r[rows], r[columns]): (r["mean"], r["std"]) for r in rows_of(summary.where(F.col("metric") == metric))}
    if not found:
        raise ValueError(f"no metric {metric!r}")
    left, top = sorted({k[0] for k in found}), sorted({k[1] for k in found})
    cell = lambda k: f"{found[k][0]:.3f} ± {found[k][1]:.3f}" if k in found else "n/a"
    return markdown([rows, *top], [[a, *[cell((a, b)) for b in top]] for a in left])


def category_pivot(counts: DataFrame, percent: bool = False) -> str:
    """Errors by category and cell with totals, or as shares."""
    found = {((r["condition"], r["model"]), r["primary_category"]): r["count"] for r in rows_of(counts)}
    cells, names = sorted({k[0] for k in found}), sorted({k[1] for k in found})
    total = {c: sum(found.get((c, n), 0) for n in names) for c in cells}
    show = lambda c, n: f"{found.get((c, n), 0) / total[c]:.1%}" if percent else found.get((c, n), 0)
    return markdown(["cell", *names, "total"], [[f"{c[0]}/{c[1]}", *[show(c, n) for n in names], total[c]] for c in cells])


def bar_chart(title: str, groups: dict[str, dict[str, float]], width: int = 640, height: int = 240) -> str:
    """A grouped bar chart of values from 0 to 1 as SVG."""
    series = sorted({s for g in groups.values() for s in g})
    step = (width - 60) / max(1, len(groups))
    bar = step / (len(series) + 1)
    shades = ("#4878a8", "#d88848", "#68a868", "#a868a8")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="{width / 2}" y="16" text-anchor="middle">{escape(title)}</text>']
    for i, (name, values) in enumerate(groups.items()):
        for j, s in enumerate(series):
            h = max(0.0, min(1.0, values.get(s, 0.0))) * (height - 70)
            out.append(f'<rect x="{50 + i * step + j * bar:.1f}" y="{height - 40 - h:.1f}" width="{bar * 0.9:.1f}" height="{h:.1f}" fill="{shades[j % 4]}"><title>{escape(s)}: {values.get(s, 0.0):.3f}</title></rect>')
        out.append(f'<text x="{50 + i * step + step / 2:.1f}" y="{height - 22}" text-anchor="middle" font-size="11">{escape(name)}</text>')
    return "".join(out) + "</svg>"


def heading_id(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-") + "-" + hashlib.sha1(title.encode()).hexdigest()[:10]


def to_html(md: str) -> str:
    """Headings with stable ids, tables and paragraphs of a Markdown report."""
    out, table = [], []

    def flush() -> None:
        if table:
            body = [r for r in table if not re.fullmatch(r"[|\s:-]+", r)]
            cells = [[c.strip() for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))] for r in body]
            size = ' class="long"' if len(cells) > 16 else ""
            out.append(f"<table{size}>" + "".join("<tr>" + "".join(f"<{t}>{escape(c)}</{t}>" for c in r) + "</tr>" for i, r in enumerate(cells) for t in ["th" if i == 0 else "td"]) + "</table>")
            table.clear()

    for line in md.split("\n"):
        if line.startswith("|"):
            table.append(line)
            continue
        flush()
        if m := re.match(r"(#{1,6}) (.*)", line):
            out.append(f'<h{len(m[1])} id="{heading_id(m[2])}">{escape(m[2])}</h{len(m[1])}>')
        elif line.strip():
            out.append(line if line.startswith("<svg") else f"<p>{escape(line)}</p>")
    flush()
    return "\n".join(out)


def report(title: str, summary: DataFrame, paired: DataFrame, categories: DataFrame, metric: str = "macro_f1") -> str:
    """A Markdown report of an experiment."""
    groups: dict[str, dict[str, float]] = {}
    for r in rows_of(summary.where(F.col("metric") == metric), "condition", "model"):
        groups.setdefault(r["condition"], {})[r["model"]] = r["mean"]
    differences = [[r["condition"], r["model"], f"{r['mean_difference']:+.3f}", r["n_improved"], r["n_worsened"]] for r in rows_of(paired.where(F.col("metric") == metric), "condition", "model")]
    return "\n\n".join([f"# {title}", f"## {metric}", mean_std_pivot(summary, metric), bar_chart(metric, groups), "## Paired differences", markdown(["condition", "model", "difference", "better", "worse"], differences), "## Error categories", category_pivot(categories)]) + "\n"
