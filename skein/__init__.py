"""skein: retrieval analytics and text-corpus operators as pure DataFrame-to-DataFrame functions on Spark."""

__version__ = "0.1.0"
