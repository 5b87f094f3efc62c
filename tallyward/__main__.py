import sys

from tallyward.cli import main

sys.exit(main())
