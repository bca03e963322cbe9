"""Whole plans: the library interface, the command line, the hook and the registered queries."""
