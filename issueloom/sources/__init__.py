"""Readers of landed data and writers of report output."""
