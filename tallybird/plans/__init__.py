"""End-to-end jobs: staged tables, trained models and the query registry."""
