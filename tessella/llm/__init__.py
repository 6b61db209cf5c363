"""Operations of a large training-data pipeline. Nothing outside this folder and corpus_pipeline.py imports it."""
