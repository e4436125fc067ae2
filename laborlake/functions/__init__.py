"""Column builders: text cleaning, parsing and inference, all JVM-side."""
