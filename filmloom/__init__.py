"""filmloom: scene-timeline analytics on Spark."""
