import sys

from treelens.command import main

sys.exit(main())
