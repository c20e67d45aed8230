"""python -m pagelathe list | run QUERY SF_DIR"""

from __future__ import annotations

import sys

from pagelathe.plans import catalog
from pagelathe.session import session


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(catalog.queries())))
        return 0
    if args[:1] == ["run"] and len(args) == 3:
        catalog.queries()[args[1]](session(), args[2]).show(50, truncate=80)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
