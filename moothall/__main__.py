"""python -m moothall QUERY SF_DIR [ROWS]: run a registered query; without arguments, list them."""

import sys

from moothall.plans.registry import QUERIES
from moothall.session import local_session

if len(sys.argv) < 3:
    print("\n".join(sorted(QUERIES)))
else:
    QUERIES[sys.argv[1]](local_session(), sys.argv[2]).show(int(sys.argv[3]) if len(sys.argv) > 3 else 20, truncate=False)
