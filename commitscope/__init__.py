"""commitscope: commit-corpus analytics as Spark DataFrame jobs.

Rows are commits (staged-diff snapshots), files, diff lines, log entries,
prompts, model responses and candidate events.  Every operator takes and
returns DataFrames; the only Python stages are the caller's inference
function and the strict JSON parser.
"""

__version__ = "0.1.0"
