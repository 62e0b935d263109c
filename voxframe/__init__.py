"""Speaker-turn analytics on DataFrames, with operators for training-data pipelines in ``llm``."""
