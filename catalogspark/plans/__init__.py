"""Registered queries: every operator over the whole test tables, with its SQL oracle where SQL can say it."""
