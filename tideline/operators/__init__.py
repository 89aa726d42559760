"""Analytic operators over points, windows, scores and segments."""
