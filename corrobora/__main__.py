import sys

from corrobora.cli import main

sys.exit(main())
