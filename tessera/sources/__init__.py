"""Readers and writers of evaluation data, run logs and text folders."""
