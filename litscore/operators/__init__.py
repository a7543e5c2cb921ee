"""The jobs' operators: DataFrame in, DataFrame out."""
