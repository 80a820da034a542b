import sys

from shiftlens.cli import main

sys.exit(main())
