"""Sources and sinks."""
from panelkit.sources.readers import *  # noqa: F401,F403
