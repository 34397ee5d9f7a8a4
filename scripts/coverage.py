"""Rewrites COVERAGE.md from the registry: survey IDs and the queries that exercise them."""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from panelforge.plans.catalog import OPERATORS, ORACLE  # noqa: E402

PATH = os.path.join(ROOT, "COVERAGE.md")


def main():
    text = open(PATH).read()
    head = text[:text.index("| IDs |")]
    ids = re.findall(r"^\| ((?:X-)?[A-Z]\d+) \|", text, re.M)
    lines = ["| IDs | query keys (oracle-checked unless marked *) |", "|---|---|"]
    for i in ids:
        names = sorted(n for n, ops in OPERATORS.items() if i in ops)
        lines.append(f"| {i} | " + (", ".join(f"`{n}`" + "*" * (n not in ORACLE) for n in names) or "none") + " |")
    open(PATH, "w").write(head + "\n".join(lines) + "\n")
    print(len(ids), "IDs;", [i for i in ids if not any(i in ops for ops in OPERATORS.values())], "without a query")


if __name__ == "__main__":
    main()
