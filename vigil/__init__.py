"""vigil: a Spark-native food-safety notice pipeline.

Every operator is a function ``DataFrame -> DataFrame`` built on the public
DataFrame / SQL / Structured Streaming API.  Column names are arguments, so the
same operator runs on reference-shaped tables and on any other table.
"""

from vigil.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
