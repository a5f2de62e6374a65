"""Forest-structure analytics as Spark tables: lidar segments, raster pixels, time series and zones."""
