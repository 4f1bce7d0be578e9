"""Log-anomaly analytics on Spark DataFrames.

Layers, from the inside out:

* ``functions``  -- Column expressions (parsing, templates, severity, risk, row features)
* ``operators``  -- DataFrame -> DataFrame steps (ordering, windows, detectors, evaluation, ensembles)
* ``sources``    -- readers, writers and the adapter that renders an event table as log lines
* ``plans``      -- whole analyses put together from operators
* ``streaming``  -- the same steps on Structured Streaming
"""

__version__ = "0.1.0"
