"""A check of the environment: ``python -m lodewright.doctor``."""

from __future__ import annotations

import importlib.util
import sys


def checks() -> list[tuple[str, bool, str]]:
    needed = ("pyspark", "pandas", "pyarrow", "numpy")
    optional = ("yaml", "duckdb", "tokenizers", "zstandard")
    out = [("python", sys.version_info >= (3, 10), sys.version.split()[0])]
    for name in (*needed, *optional):
        there = importlib.util.find_spec(name) is not None
        out.append((name, there or name in optional, "found" if there else "missing"))
    return out


def main() -> int:
    rows = checks()
    for name, good, note in rows:
        print(f"{'ok ' if good else 'BAD'} {name:<12} {note}")
    return int(not all(good for _, good, _ in rows))


if __name__ == "__main__":
    sys.exit(main())
