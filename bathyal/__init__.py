"""Survey-data analytics on Spark: DataFrame operators over point clouds, grids, routes and vector features."""
