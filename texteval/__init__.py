"""Text-generation evaluation on Spark: DataFrame in, DataFrame out."""
