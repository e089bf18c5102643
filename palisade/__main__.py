"""python -m palisade verify: prints the version."""

import sys

from . import __version__


def main(args: list[str]) -> int:
    if args[:1] == ["verify"]:
        print(f"palisade {__version__}")
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
