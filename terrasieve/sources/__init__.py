"""Sources: scene catalogs and raster blocks."""
