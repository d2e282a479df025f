"""Readers and writers. Files become rows in the scan; nothing is listed or opened on the driver by this code.

Spark's file sources skip names that start with ``_`` or ``.``.
"""
