"""Fare models with a strictly chronological evaluation."""
