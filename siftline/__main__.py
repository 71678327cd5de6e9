"""python -m siftline: the commands."""

import sys

from siftline.cli import main

if __name__ == "__main__":
    sys.exit(main())
