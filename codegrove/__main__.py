import sys

from codegrove.cli import main

sys.exit(main())
