"""python -m tessera COMMAND ...: see tessera.plans.commands."""

from __future__ import annotations

import sys

if __name__ == "__main__":
    from .plans.commands import main

    sys.exit(main(sys.argv[1:]))
