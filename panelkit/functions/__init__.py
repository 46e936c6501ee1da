"""Scalar column builders (pure ``Column -> Column``; all JVM-side, no UDFs)."""
from panelkit.functions.core import *  # noqa: F401,F403
from panelkit.functions.bands import *  # noqa: F401,F403
from panelkit.functions.text import *  # noqa: F401,F403
