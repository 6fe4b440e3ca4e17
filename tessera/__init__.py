"""Tessera: raster measurement and differential analysis as plain DataFrame functions."""
