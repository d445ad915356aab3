"""Writers: tables by part, appended text, reports and tables for print."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parts(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet, a folder for each value of ``by``; rows of a part are spread over as many files as tasks hold them."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every file, added to what is there."""
    df.write.mode("append").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A few rows of results as one JSON file, missing values kept."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def latex_table(rows: list[dict], columns: dict[str, str], digits: int = 4) -> str:
    """Rows of results as a tabular; columns are {name: heading}."""

    def cell(v) -> str:
        if v is None or v != v:
            return "--"
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("&", r"\&").replace("_", r"\_").replace("%", r"\%")

    body = [" & ".join(cell(r.get(c)) for c in columns) + r" \\" for r in rows]
    return "\n".join([rf"\begin{{tabular}}{{{'l' + 'r' * (len(columns) - 1)}}}", r"\toprule", " & ".join(columns.values()) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
