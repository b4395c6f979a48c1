"""bytequarry: analytics over labelled bytecode corpora, written for Spark's DataFrame API."""
