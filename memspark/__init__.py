"""memspark: analytics over agent memory data as Spark DataFrame functions."""
