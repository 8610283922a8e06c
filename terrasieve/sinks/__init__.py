"""Sinks: Parquet cubes and Zarr stores."""
