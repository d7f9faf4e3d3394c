"""seqmill: labelled-sequence and embedding analytics on Spark DataFrames.

Sub-packages:
  sources    readers and writers (FASTA, membership TSV, splits, vectors, results)
  functions  column expressions (vector math, string helpers, encoders)
  operators  DataFrame -> DataFrame operators (prep, splits, pairs, stats,
             residue analyses, clustering, soft alignment, embedding jobs)
  plans      fixture views over the driver tables and the query registry
  streaming  Structured Streaming variants of the stateless stages
"""

from seqmill.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
