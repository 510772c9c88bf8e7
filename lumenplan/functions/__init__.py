"""Column builders and Arrow functions: angles, Earth, sky, optics, rasters, time, text and rules."""
