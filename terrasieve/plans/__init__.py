"""Requests, grids, time axes and whole plans."""
