"""Tables written in Markdown, such as declared priors."""

from __future__ import annotations

import re

_RULE = re.compile(r"^\s*\|?(?:\s*:?-+:?\s*\|)+\s*(?::?-+:?\s*)?$")


def _cells(line: str) -> list[str]:
    body = line.strip()
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [re.sub(r"^[`*_\s]+|[`*_\s]+$", "", c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", body)]


def markdown_tables(text: str) -> list[list[dict[str, str]]]:
    """Each table of a text as rows by column name, without emphasis and code marks. Rows short of cells have empty ones."""
    lines, out = text.splitlines(), []
    i = 1
    while i < len(lines):
        if _RULE.match(lines[i]) and "|" in lines[i - 1]:
            head, rows = _cells(lines[i - 1]), []
            i += 1
            while i < len(lines) and "|" in lines[i]:
                cells = _cells(lines[i])
                rows.append({h: (cells[k] if k < len(cells) else "") for k, h in enumerate(head)})
                i += 1
            out.append(rows)
        i += 1
    return out


def declared_signs(text: str, name: str = "feature", sign: str = "sign") -> dict[str, int]:
    """Feature -> +1 or -1 from tables with those two columns; other rows ('?', '0', empty) declare nothing."""
    signs = {"+": 1, "+1": 1, "1": 1, "positive": 1, "-": -1, "\u2212": -1, "-1": -1, "negative": -1}
    return {r[name]: signs[r[sign].lower()] for t in markdown_tables(text) for r in t if name in r and r.get(sign, "").lower() in signs}
