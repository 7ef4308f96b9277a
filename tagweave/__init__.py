"""tagweave: curation and scoring of tag datasets as Spark DataFrame jobs.

Records hold an ordered list of ``{tag, explanation}`` structs whose position
carries meaning (0 domain, 1 task type, 2 difficulty, 3 language, 4+ topics).
Every operator takes and returns DataFrames; the heavy lifting is built-in
Catalyst expressions, and model calls are the only Python in the data path.
"""

from tagweave.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
