"""Score newly announced articles against a library of liked ones, as Spark jobs."""
