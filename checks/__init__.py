"""Registered queries over the driver's tables, with an SQL oracle for each."""
