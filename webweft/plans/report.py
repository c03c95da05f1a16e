"""Reports made of aggregated statistics: JSON, HTML and text."""

from __future__ import annotations

import json
from html import escape

COLORS = {2: "#2e7d32", 3: "#1565c0", 4: "#ef6c00", 5: "#c62828"}


def to_json(stats: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(stats, f, ensure_ascii=False, indent=2, default=str)


def bar_width(value: float, largest: float) -> int:
    """Per cent of the largest bar, 2 at least."""
    return max(2, round(value / largest * 100)) if largest else 2


def _bars(rows: list[tuple[str, int, str]]) -> str:
    largest = max((n for _, n, _ in rows), default=0)
    line = '<div class="row"><span>{}</span><i style="width:{}%;background:{}"></i><b>{}</b></div>'
    return "".join(line.format(escape(k), bar_width(n, largest), c, n) for k, n, c in rows) or "<p>none</p>"


def to_html(stats: dict, title: str = "Crawl report") -> str:
    """One page with the figures, bars of status codes and domains, and the errors; all text is escaped."""
    cards = "".join(f"<div><b>{escape(str(stats.get(k, '')))}</b><small>{k.replace('_', ' ')}</small></div>" for k in ("total_pages", "successful", "failed", "success_rate", "elapsed_seconds", "pages_per_second"))
    codes = _bars([(k, n, COLORS.get(int(k) // 100, "#555")) for k, n in stats.get("status_codes", {}).items()])
    domains = _bars([(d["domain"], d["pages"], "#455a64") for d in stats.get("top_domains", [])])
    errors = "".join(f"<tr><td>{escape(str(k))}</td><td>{n}</td></tr>" for k, n in stats.get("errors", {}).items())
    style = "body{font:15px sans-serif;margin:2em}.cards{display:flex;gap:1em}.cards div{background:#eee;padding:1em}small{display:block}.row{display:flex;gap:.5em;margin:.2em}.row span{width:16em}.row i{height:1em;max-width:40%}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1><section class='cards'>{cards}</section><h2>Status codes</h2>{codes}<h2>Domains</h2>{domains}<h2>Errors</h2><table>{errors}</table></body></html>"


def save_html(stats: dict, path: str, title: str = "Crawl report") -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_html(stats, title))


def error_text(stats: dict, storage: dict | None = None) -> str:
    """Error report as text from stats.error_stats(): classes, retries, URLs that failed for good, all failed URLs,
    storage errors of Saver.stats(), breakers. A part without entries says so."""
    parts = {
        "Errors by type": [f"{k}: {n}" for k, n in stats["errors_by_type"].items()],
        "Retries": [f"{k}: {v}" for k, v in stats["retry"].items()],
        "Permanent": stats["permanent"],
        f"Failed ({stats['n_failed_urls']})": [f"{u}: {why}" for u, why in stats["failed"].items()],
        "Storage": [f"failed rows: {storage['failed']}", *storage["errors"]] if storage and (storage["failed"] or storage["errors"]) else [],
        "Breakers": [f"{b['domain']}: {b['state']}, opened {b['opened_times']}" for b in stats["breaker"]],
    }
    return "\n".join(line for name, rows in parts.items() for line in (name, *(f"  {r}" for r in rows or ["none"]))) + "\n"


def save_error_text(path: str, stats: dict, storage: dict | None = None) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(error_text(stats, storage))
