"""Column expressions. None of them needs Python at run time."""
