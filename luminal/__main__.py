"""python -m luminal validate data.json: whether a file has records that can be placed."""

from __future__ import annotations

import json
import sys


def faults(data) -> list[str]:
    rows = data if isinstance(data, list) else next((data[k] for k in ("records", "nodes", "data") if isinstance(data, dict) and isinstance(data.get(k), list)), None)
    if rows is None:
        return ["no records, nodes or data"]
    out = [f"record {i} is no object" for i, r in enumerate(rows) if not isinstance(r, dict)]
    out += [f"record {i} has no id" for i, r in enumerate(rows) if isinstance(r, dict) and r.get("id") is None]
    return out if rows else ["there are no records"]


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] != "validate":
        print(__doc__)
        return 2
    try:
        with open(args[1], encoding="utf-8") as f:
            found = faults(json.load(f))
    except (OSError, ValueError) as e:
        found = [str(e)]
    print("\n".join(found) or "valid")
    return int(bool(found))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
