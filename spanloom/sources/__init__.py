"""Scans and sinks: text, tables, marked-up and binary inputs as position-keyed relations."""
