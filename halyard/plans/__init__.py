"""Registered queries: what each operator says on the driver's tables, with the same in SQL."""
