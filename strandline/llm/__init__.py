"""Training-data operators: one module per operator, queries in :mod:`strandline.llm.entries`."""
