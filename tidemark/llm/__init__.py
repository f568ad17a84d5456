"""Operators that prepare text corpora for the training of language models.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns a lazy DataFrame; what it must materialise on the way goes to the folder
that the session names in ``spark.checkpoint.dir``.
"""
