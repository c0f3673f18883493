"""Passage retrieval as Spark DataFrame programs.

Documents become typed blocks, blocks become parent and child passages, and
batches of queries are answered by lexical, vector, fused, reranked and
cascaded search.  Every public function takes and returns DataFrames.
"""

__version__ = "0.1.0"
