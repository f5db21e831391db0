"""Voxelloom: volumetric analytics on PySpark DataFrames.

Volumes are DataFrames, one row per voxel or one row per block; every operator
maps DataFrames to DataFrames and leaves the physical plan to Catalyst.
"""

__version__ = "0.1.0"
