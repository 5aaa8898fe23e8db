"""plumbline: pipeline-integrity analytics expressed as Spark plans."""
