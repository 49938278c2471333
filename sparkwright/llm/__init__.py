"""Training-data operators: whole-corpus text jobs written as Spark jobs.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
plus the names of its id and text columns, reads only those two, and states in
its docstring what it does with nulls, empty texts, ties and repeated rows.
"""
