"""Detectors.  Each module has ``fit(...) -> fitted`` and ``score(..., fitted) -> DataFrame``.

In every score higher means more anomalous.
"""
