"""Page monitoring and change analytics on PySpark.

Pages are rows. A job specification says which containers to select on a page and which named fields to read from
them; everything after that (matching, dedup, records, digests, signals, frontiers) is DataFrame work.
"""

from pagewatch.spec import FieldSpec, JobSpec

__all__ = ["FieldSpec", "JobSpec"]
