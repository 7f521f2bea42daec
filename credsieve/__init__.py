"""credsieve: a PySpark-native engine that finds leaked credentials in tables of text."""
