"""Text-corpus analytics on Spark: which sentences are readable, what to learn next, and the pipeline around it."""
