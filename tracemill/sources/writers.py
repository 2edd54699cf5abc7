"""Writing results: CSV with a fixed column order, sorted JSON, and the text reports made of small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.sources.files import BACKFILLED, RESULTS

#: Rows of an aggregate that a text report takes at most; more is an error, not a cut.
REPORT_ROWS = 10_000


def write_results(facts: DataFrame, path: str) -> None:
    """The fact table as CSV in the contract's order; missing observability columns are backfilled, others null. Committed as a whole."""
    names = [(x.rsplit(" ", 1)[0].strip(), x.rsplit(" ", 1)[1]) for x in RESULTS.split(",")]
    held = [F.col(n) if n in facts.columns else F.lit(BACKFILLED.get(n)).cast(t).alias(n) for n, t in names]
    facts.select(*held).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def sorted_json(columns: list[str]) -> Column:
    """A row as JSON with its keys in order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a row, keys in order, in folders by `by`."""
    rest = [c for c in df.columns if c not in (by or [])]
    out = df.select(*(by or []), sorted_json(rest).alias("value"))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def _rows(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError("a report takes aggregates, not tables")
    return rows


def _cell(v) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def markdown_table(df: DataFrame) -> str:
    """A small aggregate as a Markdown table."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(_cell(v).replace("|", "\\|") for v in r) + " |" for r in _rows(df))]) + "\n"


def latex_table(df: DataFrame, caption: str) -> str:
    """A small aggregate as a LaTeX tabular."""
    clean = lambda t: "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(c, c) for c in t)
    head = " & ".join(clean(c) for c in df.columns) + r" \\"
    body = [" & ".join(clean(_cell(v)) for v in r) + r" \\" for r in _rows(df)]
    return "\n".join([r"\begin{table}", rf"\caption{{{clean(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"]) + "\n"


def run_report(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown report of small aggregates, one section each."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())
