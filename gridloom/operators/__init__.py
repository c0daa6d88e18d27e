"""Operators on grids (r, c, v), cubes, zones, points and edges, as DataFrames."""
