"""Reading and writing of tables, landed files and model artifacts."""
