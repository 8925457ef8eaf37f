"""Searching from the command line: python -m citegrove.sources.command --provider openalex --query "soil" --out found.json"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from citegrove.sources.connectors import Client, count, limit_of, query_of, search, warning


def main(arguments: list[str] | None = None, client: Callable[[str], Client] = Client) -> int:
    """Writes the records of a search as a JSON list; with --count only says how many there are."""
    p = argparse.ArgumentParser(prog="citegrove-search")
    p.add_argument("--provider", choices=("openalex", "crossref", "pubmed", "zotero"), default="openalex")
    p.add_argument("--query", required=True)
    p.add_argument("--max", type=int, default=100)
    p.add_argument("--unlimited", action="store_true")
    p.add_argument("--out")
    p.add_argument("--library", default="")
    p.add_argument("--sort", choices=("citations", "date"))
    p.add_argument("--count", action="store_true")
    for name in ("since", "until", "language", "type"):
        p.add_argument(f"--{name}")
    p.add_argument("--open-access", action="store_true")
    a = p.parse_args(arguments)
    q = query_of(vars(a) | {"open_access": str(a.open_access)})
    web = client(a.provider)
    if a.count:
        n = count(a.provider, q, web)
        print(warning(n) or n)
        return 0
    found = list(search(a.provider, q, limit_of(a.max, a.unlimited), web, a.sort, a.library))
    body = json.dumps(found, ensure_ascii=False, indent=1)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(body)
        print(f"{len(found)} records in {a.out}")
    else:
        print(body)
    return 0


if __name__ == "__main__":
    sys.exit(main())
