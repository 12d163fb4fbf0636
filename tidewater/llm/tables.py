"""Reading inputs and writing intermediate tables, as in the rest of the library."""

from tidewater.sources.store import materialise, new_path
from tidewater.sources.views import table as load

__all__ = ["load", "materialise", "new_path"]
