"""Detection analytics on Spark: annotations, tiles, tile gate, NMS, evaluation and diagnosis as DataFrame operators."""
