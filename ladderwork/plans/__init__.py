"""Derived inputs and registered queries."""
