"""Registered queries over the shipped tables, each with its SQL oracle."""
