"""Training-data operators: thirteen Spark jobs over a table of documents.

Nothing outside this subpackage, ``tests/llm`` and ``corpus_pipeline.py``
imports it.  Tables are read with Spark only, wide intermediate results are
written to the shared checkpoint folder, and numpy runs inside tasks on
Arrow buffers.
"""
