"""edgewright: edge-classification data processing on Spark DataFrames.

Graph collections are plain DataFrames (``graphs``, ``nodes``, ``edges``,
``pairs``); every operator maps DataFrames to DataFrames and leaves the physical
strategy to Catalyst and AQE.
"""

__version__ = "0.1.0"
