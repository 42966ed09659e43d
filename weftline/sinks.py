"""Reports: JSON through Spark, text and Markdown rendered by the driver from rows that a site's report holds."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from typing import Any

from pyspark.sql import DataFrame

PASS = 70


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def passes(score: int | None) -> bool:
    return score is not None and score >= PASS


def safe(text: Any, markdown: bool = False) -> str:
    """Text that others wrote, on one line: control and format characters as spaces, and Markdown's marks escaped."""
    plain = "".join(" " if unicodedata.category(c) in ("Cc", "Cf") else c for c in str("" if text is None else text))
    plain = re.sub(r"\s+", " ", plain).strip()
    return re.sub(r"([\\`*_{}\[\]()<>#+!|~-])", r"\\\1", plain) if markdown else plain


def _table(rows: list[dict], columns: list[str]) -> list[str]:
    cells = [[safe(r.get(c), markdown=True) for c in columns] for r in rows]
    return ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |", *["| " + " | ".join(c) + " |" for c in cells]]


def site_report(score: int | None, coverage: dict, fixes: list[dict], issues: list[dict], defects: list[dict], style: str = "markdown") -> str:
    """The report of a site in json, markdown, text or agent (a decision in short) style."""
    if style == "json":
        return json.dumps({"aggregate_score": score, "coverage": coverage, "fixes": fixes, "issues": issues, "defects": defects}, ensure_ascii=False, sort_keys=True, default=str)
    if style == "agent":
        return json.dumps({"score": score, "pass": passes(score), "top_fixes": [f.get("title") for f in fixes[:3]], "critical_defects": sum(d.get("severity") == "critical" for d in defects)}, ensure_ascii=False, default=str)
    parts = [("Fixes", fixes), ("Cross-cutting issues", issues), ("Defects", defects)]
    if style == "text":
        lines = [f"Score {score}/100 ({'pass' if passes(score) else 'fail'})"]
        for name, rows in parts:
            lines += ["", name, *["  " + "  ".join(f"{k}={safe(v)}" for k, v in r.items()) for r in rows]]
        return "\n".join(lines)
    lines = [f"# Score {score}/100", "", f"{coverage.get('pages_audited', '?')} of {coverage.get('pages_discovered', '?')} pages ({safe(coverage.get('confidence'), True)})"]
    for name, rows in parts:
        if rows:
            lines += ["", f"## {name}", "", *_table(rows, list(rows[0]))]
    return "\n".join(lines)


def page_report(row: Any, style: str = "markdown") -> str:
    """One row of page_audits."""
    factors = [{"factor": f.name, "score": f.score, "weight": f.weight} for f in row.factors]
    if style == "json":
        return json.dumps(row.asDict(recursive=True), ensure_ascii=False, sort_keys=True, default=str)
    if style == "text":
        return "\n".join([safe(row.url), row.summary, *[f"  {f['score']:>3} {f['factor']}" for f in factors]])
    return "\n".join([f"# {safe(row.url, True)}", "", safe(row.summary, True), "", *_table(factors, ["factor", "score", "weight"])])


def compare_report(report: dict, pages: list[dict]) -> str:
    worse = [p for p in pages if p["change"] in ("regressed", "dropped", "removed")]
    lines = [f"# {safe(report.get('result'), True)}: {safe(report.get('verdict'), True)}", "", f"{report.get('regression_count', 0)} dimensions got worse."]
    return "\n".join([*lines, "", *(_table(worse, ["url", "baseline", "current", "delta", "change"]) if worse else [])])


def exit_code(score: int | None = None, verdict: str | None = None, error: bool = False) -> int:
    """0 for a pass, 1 for a score below PASS or a failed comparison, 2 for a comparison that can't be made."""
    if error:
        return 2
    return int(verdict == "fail") if verdict is not None else int(not passes(score))


# Codes of failures.
ERRORS = ("BAD_INPUT", "INVALID_URL", "UNSUPPORTED_PROTOCOL", "UNREACHABLE", "BLOCKED_HOST", "BLOCKED_IP", "TIMEOUT", "REDIRECT_LIMIT", "BODY_TOO_LARGE", "NOT_HTML", "COMPARE_MISCONFIG", "BUDGET_EXCEEDED")


def failed(code: str, message: str) -> int:
    """Says a failure with its code, and returns its exit code: 2."""
    if code not in ERRORS:
        raise ValueError(f"unknown code {code}")
    print(f"{code}: {safe(message)[:300]}", file=sys.stderr)
    return exit_code(error=True)


def ci_outputs(path: str, values: dict) -> None:
    """Adds key=value lines to the file in which a build reads a step's outputs; lists and maps are left out."""
    with open(path, "a", encoding="utf-8") as f:
        for k, v in values.items():
            if not isinstance(v, (list, dict)):
                f.write(f"{k.replace('_', '-')}={safe(str(v).lower() if isinstance(v, bool) else v)}\n")
