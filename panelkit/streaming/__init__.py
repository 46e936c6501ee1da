"""Structured Streaming forms of the keyed counters (survey §2.11)."""
from panelkit.streaming.counters import *  # noqa: F401,F403
