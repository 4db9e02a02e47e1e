import sys

from gridloom.plans.runner import main

if __name__ == "__main__":
    sys.exit(main())
