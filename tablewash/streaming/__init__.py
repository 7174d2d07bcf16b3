from tablewash.streaming.stream import NotStreamable, apply_recipe_stream, start_parquet_sink

__all__ = ["NotStreamable", "apply_recipe_stream", "start_parquet_sink"]
