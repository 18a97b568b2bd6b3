"""Relational operators over pixels, histograms, lines and scan catalogs."""
