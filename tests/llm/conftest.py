"""Plain versions are shared between these test modules."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
