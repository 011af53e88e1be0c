"""Print the operator inventory of the README from the registry: python tools/inventory.py."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.plans import catalogue  # noqa: E402


def main() -> None:
    by_id: dict[str, list[str]] = {}
    for name, q in catalogue().items():
        for op in q.operators.split():
            by_id.setdefault(op, []).append(name + ("" if q.sql else " (rows only)"))
    def order(op: str) -> tuple:
        return "SJPWXARE BMT".index(op[0]), int(re.sub(r"\D", "", op))
    for op in sorted(by_id, key=order):
        print(f"| {op} | {', '.join('`' + n.replace(' (rows only)', '') + '`' + (' (rows only)' if 'rows only' in n else '') for n in by_id[op])} |")


if __name__ == "__main__":
    main()
