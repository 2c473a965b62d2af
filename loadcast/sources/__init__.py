"""Reading and writing: CSV series, gridded cubes, load sheets, tables."""
