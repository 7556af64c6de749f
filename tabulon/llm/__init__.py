"""Operators for preparing training text.

Nothing else in the library imports this folder.  Each module holds one
operator with a general interface and, at its end, the registered query and
the SQL that checks it where SQL can.
"""
