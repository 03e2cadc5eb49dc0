"""Readers and writers: tables, access logs, run directories."""
