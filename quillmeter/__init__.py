"""quillmeter: Spark-native analytics over AI-assisted development activity."""
