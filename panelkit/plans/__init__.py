"""Composed plans: the stand-in panel, reports, models, audit."""
